"""Small cases with known numbers, and brute-force checks of operators that SQL cannot express."""

import math
import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from mnemora.functions import scoring, text as tx
from mnemora.operators import chunking, filters, graph, ranking, reconcile, session_memory, set_join, vectors
from mnemora.plans import retrieval
from mnemora.sources import memories as stored
from mnemora.streaming import flows, gates

AS_OF = 1722470400


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("<private>x</private>", True), ("a <PRIVATE>x\ny</PRIVATE>", False), ("  <private>x</private> <private>y</private>\n", True)])
def test_fully_private(spark, text, expected):
    assert one(spark, text, tx.fully_private) is expected


@pytest.mark.parametrize("text, expected", [
    ("hello!", True), ("谢谢。", True), ("", True), ("git status shows nothing", True), ("We chose PostgreSQL for the service", False)])
def test_noise(spark, text, expected):
    assert one(spark, text, tx.is_noise) is expected


@pytest.mark.parametrize("text, expected", [
    ("do you remember what we discussed", "strong"), ("上次说的方案", "strong"), ("i prefer tabs", "medium"), ("部署到服务器", "medium"),
    ("please refactor this", "weak"), ("sum of two numbers", "none")])
def test_recall_signal(spark, text, expected):
    assert one(spark, text, tx.recall_signal) == expected


def test_fresh_memory_keeps_full_recency(spark):
    row = spark.createDataFrame([(1.0, 1.0, "core", 0)], "importance double, confidence double, tier string, access_count int")
    row = row.withColumn("created_at", F.timestamp_seconds(F.lit(AS_OF))).withColumn("last_accessed_at", F.lit(None).cast("timestamp"))
    got = row.select(scoring.recency(F.col("importance"), AS_OF, scoring.Decay()).alias("r"), scoring.raw_strength(AS_OF).alias("s")).first()
    assert got["r"] == pytest.approx(1.0)
    assert got["s"] == pytest.approx(0.4 + 0.3)


def test_half_life(spark):
    row = spark.createDataFrame([(0.0, 1.0, "working", 0)], "importance double, confidence double, tier string, access_count int")
    row = row.withColumn("created_at", F.timestamp_seconds(F.lit(AS_OF - 30 * 86400))).withColumn("last_accessed_at", F.lit(None).cast("timestamp"))
    assert row.select(scoring.recency(F.col("importance"), AS_OF, scoring.Decay()).alias("r")).first()["r"] == pytest.approx(0.5)


def test_normalise_single_and_equal(spark):
    rows = spark.createDataFrame([(1, 1, 0.004), (2, 1, 0.02), (2, 2, 0.02)], "query_id int, memory_id int, score double")
    got = {(r["query_id"], r["memory_id"]): r["score"] for r in ranking.minmax(rows).collect()}
    assert got[1, 1] == pytest.approx(0.48) and got[2, 1] == got[2, 2] == 1.0


def test_chain_tail_stops_in_cycles(spark):
    ids = spark.range(1, 9).select("id")
    links = [(1, 2), (2, 3), (3, 4), (5, 6), (6, 7), (7, 6), (8, 99)]
    relations = spark.createDataFrame([(a, "continued_by", b) for a, b in links], "src_id long, relation_type string, target_id long")
    got = {r["id"]: r["tail_id"] for r in graph.chain_tail(ids, relations).collect()}
    # 5 walks 6, 7 and would come to 6 again; 6 ends on 7, 7 on 6; 8 points to a missing memory
    assert got == {1: 4, 2: 4, 3: 4, 4: 4, 5: 7, 6: 7, 7: 6, 8: 8}


def test_set_join_equals_brute_force(spark):
    random.seed(3)
    rows = [(n, n % 3, sorted({f"w{random.randint(0, 14)}" for _ in range(random.randint(1, 9))})) for n in range(120)]
    rows += [(1000 + n, 1, ["a", "b", "c"]) for n in range(40)]  # a group of copies
    df = spark.createDataFrame(rows, "id int, grp int, tokens array<string>")
    for threshold in (0.3, 0.6, 0.85):
        got = {(r["a"], r["b"]) for r in set_join.pairs_within(df, ["grp"], threshold).collect()}
        want = {
            (a, b) for a, g, x in rows for b, h, y in rows
            if a < b and g == h and len(set(x) & set(y)) / len(set(x) | set(y)) > threshold}
        assert got == want


def test_neighbours_equal_brute_force_with_many_copies(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    points = np.vstack([centres[rng.integers(0, 6, 90)] + rng.normal(scale=0.2, size=(90, 8)), np.tile(centres[0], (45, 1))])
    df = spark.createDataFrame([(n, [float(x) for x in p]) for n, p in enumerate(points)], "memory_id long, embedding array<double>")
    got = sorted((r["memory_id"], r["neighbour_id"]) for r in vectors.similar_neighbours(df, 0.85, 6, pivots=5, cell_rows=20).collect())
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = []
    for n, row in enumerate(scores):
        best = sorted(range(len(row)), key=lambda m: (-row[m], m))[:6]
        want += [(n, m) for m in best if row[m] >= 0.85]
    assert got == sorted(want)


def test_blocked_search_equals_scan(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(rng.normal(size=(60, 5)))]
    base = spark.createDataFrame(rows, "memory_id long, embedding array<double>")
    asked = spark.createDataFrame(rows[:20], "query_id long, embedding array<double>")
    scan = vectors.vector_topk(asked, base, 4).collect()
    blocks = vectors.vector_topk(asked, base, 4, query_bound=7, cell_rows=11).collect()
    assert sorted(map(tuple, scan)) == sorted(map(tuple, blocks))


def test_overlap_keeps_all_bytes():
    text = "é" * 300 + "\n## head\n" + "x" * 500 + "\n\n" + "世界" * 200
    parts = chunking.overlapping(text, 256, 32)
    assert all(len(p.encode()) <= 256 for p in parts)
    rebuilt = parts[0]
    for part in parts[1:]:
        common = next(n for n in range(min(len(rebuilt), len(part)), -1, -1) if rebuilt.endswith(part[:n]))
        rebuilt += part[common:]
    assert set(rebuilt) == set(text) and parts[-1].endswith("世界")


def test_paragraph_merge(spark):
    old = "## 2024-05-02 10:00 deploy\nlong old body\n\n## 2024-05-01 09:00 tests\nok"
    new = "## 2024-06-01 11:00 deploy\nshort\n## 2024-04-01 08:00 other\nnew"
    pairs = [(old, new), ("", "x"), ("x", " "), ("intro\n## a heading\nb", "## a headings\nlonger body"), ("## first\nx", "start\n## second\ny")]
    got = [r[0] for r in spark.createDataFrame(pairs, "old string, new string").select(
        chunking.paragraph_merge(F.col("old"), F.col("new"))).collect()]
    assert got[0] == ("## 2024-04-01 08:00 other\nnew\n\n## 2024-05-01 09:00 tests\nok\n\n## 2024-06-01 11:00 deploy\nlong old body")
    assert got[1:3] == ["x", "x"]
    assert got[3] == "intro\n\n## a headings\nlonger body" and got[4] == "start\n\n## first\nx\n\n## second\ny"


def topic(no, title, summary, kind="WORK"):
    return {"session_id": "s", "topic_no": no, "kind": kind, "topic": title, "summary": summary, "overview": "", "detail": "", "tags": ["t"]}


def test_fold_session_appends_replaces_and_continues():
    rows = session_memory.fold_session([], [topic(1, "a", "first"), topic(2, "b", "second"), topic(3, "b", "third"), topic(4, "c", "y" * 2990)], "2024-01-01 00:00")
    head, child = rows
    assert "## 2024-01-01 00:00 b\nthird" in head["content"] and "second" not in head["content"] and head["content"].startswith("first")
    assert child["parent_id"] == head["id"] and child["content"].startswith("## 2024-01-01 00:00 c")
    again = session_memory.fold_session([], [topic(1, "a", "x", "EMOTIONAL"), topic(2, "a", "x", "EMOTIONAL")], "d")
    assert len(again) == 1 and again[0]["content"] == "x"


def test_recall_gate_rules():
    last, reason = gates.judge(None, 100, 0.1)
    assert (last, reason) == (100, "ok")
    assert gates.judge(100, 129, 0.0) == (100, "rate_limited")
    assert gates.judge(100, 130, 0.9) == (130, "similarity_too_high")
    assert gates.judge(100, 130, math.nan) == (130, "ok")


def test_decode_gives_defaults(spark):
    row = stored.decode_memories(spark.createDataFrame([("1", "not json")], "id string, tags string")).first()
    assert row["tags"] == [] and row["tier"] == "peripheral" and row["version"] == 1 and row["provenance"] is None


def test_split_overflow_prefers_heading(spark):
    text = "intro\n## one\n" + "a" * 20 + "\n## two\nrest"
    got = spark.createDataFrame([(text,)], "t string").select(F.inline(F.array(tx.split_overflow(F.col("t"), 40)))).first()
    assert got["first"].endswith("a" * 20) and got["second"] == "## two\nrest"


def test_string_ids_and_stores(spark):
    """Ids made by hashing are strings; look-ups stay in the tenant's store."""
    memories = spark.createDataFrame(
        [("m-b", "t1", "s", "2024-01-01 00:00:00", "tea is good", "global", None), ("m-a", "t1", "s", "2024-01-02 00:00:00", "tea is good", "global", None),
         ("m-c", "t2", "s", "2024-01-03 00:00:00", "tea is good", "global", None)],
        "id string, tenant_id string, session_id string, updated_at string, content string, visibility string, project_path string",
    ).withColumn("updated_at", F.to_timestamp("updated_at")).withColumn("l0_abstract", F.col("content"))
    known = memories.select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    facts = spark.createDataFrame(
        [("f1", "b", 0, "t1", "s", "tea is good", 4, 0.5, [1.0, 0.0], None, None)],
        "fact_id string, batch_id string, fact_index int, tenant_id string, session_id string, l0_abstract string, llm_confidence int, "
        "admission_weight double, embedding array<double>, conversation string, project_path string")
    row = reconcile.admission_score(facts, memories, known, "2024-01-12 00:00:00").first()
    assert row["max_similarity"] == 1.0 and abs(row["recency"] - (1 - math.exp(-10 / 30))) < 1e-9
    got = reconcile.gather_existing(facts, memories, known).orderBy("place").collect()
    assert [r["memory_id"] for r in got] == ["m-a", "m-b"]


def test_access_keys_keep_stores_apart(spark):
    queries = spark.createDataFrame([(1, "t1", "a")], "query_id int, tenant_id string, agent_id string")
    spaces = spark.createDataFrame([("t1", "team/x")], "user_id string, space_id string")
    keys = set(retrieval.query_access(queries, spaces).first()["access_keys"])
    rows = spark.createDataFrame(
        [(1, "t1", "global", ""), (2, "t2", "global", ""), (3, "t1", "private", "a"), (4, "t2", "private", "a"), (5, "t2", "shared:team/x", "")],
        "id int, tenant_id string, visibility string, owner_agent_id string")
    seen = [r["id"] for r in rows.select("id", filters.store_key().alias("k")).collect() if r["k"] in keys]
    assert seen == [1, 3, 5]


def test_all_chunks_are_kept_by_default(spark):
    rows = spark.createDataFrame([(1, "line\n" * 400)], "id int, text string")
    assert chunking.split_overlap(rows, 100, 10).count() > 5 == chunking.split_overlap(rows, 100, 10, keep=5).count()


def test_noise_similarity_has_no_limit(spark):
    prototypes = spark.range(5000).select(F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    facts = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    assert vectors.noise_similarity(facts, prototypes).first()["is_noise"]


def test_session_memory_over_two_batches(spark):
    """A batch starts from what the one before it left: the same texts as in one batch."""
    stored = spark.createDataFrame(
        [("m", "s", "WORK", "start", "t", "o", "d", ["x"], None)], "id string, session_id string, kind string, content string, l0_abstract string, "
        "l1_overview string, l2_content string, tags array<string>, created_at timestamp")
    rows = [("s", n, "u", title, text, "", "", "WORK", "events", "global", ["t"], "src", None)
            for n, (title, text) in enumerate([("a", "first"), ("b", "y" * 790), ("c", "z" * 790), ("d", "w" * 790), ("e", "v" * 790), ("a", "again"), ("f", "last")])]
    topics = spark.createDataFrame(
        rows, "session_id string, topic_no int, tenant_id string, topic string, summary string, overview string, detail string, memory_type string, "
        "category string, scope string, tags array<string>, ingest_source string, project_path string")
    whole = session_memory.append_topics(stored, topics, "2024-01-01 00:00:00")
    log = flows.work_folder(spark, "test-log")
    body = flows.stream_session_memory(stored, "2024-01-01 00:00:00", log)
    for number in (0, 1):
        for _ in range(2):  # a repeated batch changes nothing
            body(topics.filter((F.col("topic_no") >= 4) == (number == 1)), number)
    state = flows.session_state(stored, log, 2)
    want = sorted((r["id"], r["content"]) for r in whole.collect())
    assert len(want) > 1 and sorted((r["id"], r["content"]) for r in state.collect()) == want


def test_clean_message_takes_out_blocks_of_any_host(spark):
    text = "a<Acme-context>x\ny</Acme-context>b\n<acme-profile>open\n[ACME-MEMORY]z[/ACME-MEMORY]c <plain-note>d</plain-note>"
    frame = spark.createDataFrame([(text,)], "t string")
    want = "ab\nc <plain-note>d</plain-note>"
    assert frame.select(tx.clean_message(F.col("t"))).first()[0] == want
    assert frame.select(tx.clean_message(F.col("t"), "other")).first()[0] == text


def test_chunks_leave_a_task_in_small_batches():
    """Chunks of a whole Arrow batch were held at once, as Python texts and again as Arrow."""
    texts = ["é" * 1_500_000, "b\n" * 10, "c" * 700_000] * 4
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    made = list(chunking._chunks(80_000, 2_000, None)(iter([batch])))
    assert max(b.nbytes for b in made) < 3 * chunking.BATCH_BYTES
    rows = [(r["id"], r["chunk_no"], r["chunk"]) for b in made for r in b.to_pylist()]
    assert rows == [(i, n, c) for i, t in enumerate(texts) for n, c in enumerate(chunking.overlapping(t, 80_000, 2_000))]
    last = [r for b in chunking._chunks(80_000, 2_000, 2)(iter([batch])) for r in b.to_pylist()]
    assert [r["chunk_no"] for r in last if r["id"] == 1] == [0] and sum(r["id"] == 0 for r in last) == 2
