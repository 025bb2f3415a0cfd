"""Guarded text rules against the plain patterns, on texts that hold marks, parts of them and odd letters."""

import pytest
from pyspark.sql import functions as F

from mnemora.functions import patterns as P
from mnemora.functions import text as tx
from mnemora.plans import ingest
from mnemora.functions.columns import WHITE, lines, strip, strip_end, strip_start

TEXTS = [
    "", " \n　", "hello!", " Hey  ", "say hello", "I don't have any information", "i dont have DATA on it", "I couldn’t find any",
    "I couldnt find any", "no relevant memory found", "do you remember me", "你知道他吗", "你知道", "query -> none", "query->NONE", "no explicit  solution",
    "search returned 0 results", "search returned", "extracted 4 facts", "Extracted facts", "found 3 matching", "ſystem-reminder", "bacKground tasK",
    "gİt status", "gıt log", "GIT Push", "git pull", "compreſsion #3", "Compression #12 removed", "task_id: a bg_1", "task_id session_id", "task_id",
    "session_id:  ses_1", "cargo run", "npm install", "http 404", "HTTP x", "status code 5", "docker ps", "3 files changed", "a file created", "12 file modified",
    "build failed", "test result: ok", "3 passed, 4 failed", "compressed block", "compressed 3 messages", "[system-reminder]", "background_output", "Thinking自检",
    "完成DCP压缩#3", "移除-3.5K数据", "新增+2K摘要", "7K removed + a summary", "removed summary", "▣ DCP", "▪dcp", "grep a pattern", "<system-reminder>", "<private>git add",
    "reconciliation complete", "semantic search", "lsp_diagnostics ast_grep playwright_browser", "dcp-message-id", "thanks", "谢谢！", "我没有相关的记忆 ", "HEARTBEAT  ",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "t string").cache()


def differing(rows, left, right):
    return [r[0] for r in rows.filter(~left.eqNullSafe(right)).collect()]


def test_noise_and_meta_are_the_plain_patterns(texts):
    t = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    noise = (t == "") | F.rlike(t, F.lit("(?iU)" + P.any_of(P.NOISE))) | F.rlike(t, F.lit("(?U)" + P.any_of(P.NOISE_CASED)))
    assert differing(texts, tx.is_noise(F.col("t")), noise) == []
    lower = F.lower("t")
    words = F.lit(False)
    for word in P.META_WORDS:
        words = words | lower.contains(word)
    meta = (words | F.rlike("t", F.lit("(?iU)" + P.any_of(P.META)))) & ~F.col("t").contains("<private>")
    assert differing(texts, tx.is_meta(F.col("t")), meta) == []


def test_patterns_are_tried_behind_marks():
    """Without a mark, one text of a megabyte meets fifty patterns at every place."""
    assert [p for p in P.NOISE + P.META if not p.startswith("^") and p not in P.MARKS] == []


def test_strip_takes_every_white_space(spark):
    sides = spark.createDataFrame([(w + "a" + w + "b" + w + "\r\n",) for w in WHITE + "​᠎﻿\x1c"], "t string")
    for mine, plain in ((strip, r"(?U)^\s+|\s+$"), (strip_end, r"(?U)\s+$"), (strip_start, r"(?U)^\s+")):
        assert differing(sides, mine(F.col("t")), F.regexp_replace("t", plain, "")) == []


def uses(rows, column, function: str) -> int:
    return rows.select(column.alias("c"))._jdf.queryExecution().analyzed().toString().count(function)


def test_a_message_is_cleaned_once(texts):
    """Lines and cleaned texts named twice were worked out twice, with all that lies before them."""
    assert uses(texts, lines(F.col("t")), "split(") == 1
    assert uses(texts, tx.clean_message(F.col("t")), "split(") == 1
    assert uses(texts, tx.strip_envelope(F.col("t")), "System:") == 2  # mark and pattern


def test_lines(spark):
    rows = spark.createDataFrame([("",), ("\n",), ("a\r\nb\n",), ("a\n\n",), (None,)], "t string").select(lines(F.col("t")))
    assert [r[0] for r in rows.collect()] == [[], [""], ["a", "b"], ["a", ""], None]


CASES = [
    ("<thinking>a\nb</thinking> c\r\n\r\n d ", "c\n d"), ("<analysis>open\nnext", "next"), ("< omoc: x</>y", "y"), ("<mem-context>q</mem-context>z", "z"),
    ("[MEM-MEMORY]q[/MEM-MEMORY]z", "z"), ("a OH-MY-OPENCODE b", "a  b"), ("a\n <dcp x\n</dcf\nb", "a\nb"), ("a < b > c [d] M", "a < b > c [d] M"),
    ("<thin<thinking>a</thinking>king>rest\nkept", "kept"), ("", ""), (" \n ", ""),
]


def test_clean_message(spark):
    rows = spark.createDataFrame([(t, w) for t, w in CASES], "t string, w string")
    got = rows.select(tx.clean_message(F.col("t")), "w").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_content_kind_counts_words_to_500(spark):
    words = ["w " * 499, " w" * 500, "w　w\n" * 249 + "w", "w\n" * 250 + "w ​" * 250, "# a", "a\n## b", "a\n### b", "x" * 80_001, "\nuser: a" * 3, ""]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(tx.content_kind(F.col("t")))
    assert [r[0] for r in rows.collect()] == [
        "note", "structured", "note", "structured", "structured", "structured", "note", "large", "conversation", "note"]


def test_import_judges_a_text_once(spark):
    """The kind of every text was worked out in each of four branches and its parts were joined to the texts again."""
    files = spark.createDataFrame(
        [("t", 1, "# a\nx\n# b\ny", "auto"), ("t", 2, "line\n" * 40_000, "auto"), ("t", 3, "plain", "auto"), ("t", 4, "known", "auto"),
         ("t", 5, "# a\n# b", "note"), ("t", 6, "short", "conversation"), ("t", 7, "line\n" * 40_000, "note"), ("t", 8, "line\n" * 40_000, "conversation")],
        "task_id string, file_no int, text string, strategy string")
    known = files.filter("file_no = 4").select(F.sha2("text", 256).alias("content_hash"))
    parts, counts = ingest.import_batch(files, known)
    got = {(r["file_no"], r["kind"]): r["n"] for r in parts.groupBy("file_no", "kind").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "structured"): 2, (2, "large"): 3, (3, "note"): 1, (5, "note"): 1, (6, "conversation"): 1, (7, "note"): 1, (8, "conversation"): 3}
    assert set(parts.columns) == {"id", "part_no", "content", "task_id", "file_no", "kind", "session_id"}
    assert counts.first().asDict() == {"task_id": "t", "files": 8, "rejected": 1, "parts": 12}
    plan = parts._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_count") <= 3 and plan.count("Join") <= 3  # 10 and 6 before
