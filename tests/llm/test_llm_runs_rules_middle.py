"""Periodic runs, quality rules and fill-in-middle against plain Python, on small tables with every awkward case."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_llm_operators import documents, pairs, sentence

import __spark_entry__ as entry
from mnemora.llm import common, fill_middle, periodic_runs, quality_rules
from mnemora.llm import words as W

SF = "/root/testdata/sf0.001"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    common.prepared(spark)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= max(12 - q, q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def without_repeats(w, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    rng = random.Random(5)
    fib = ["a", "a b"]
    while len(fib[-1]) < 900:
        fib.append(f"{fib[-1]} {fib[-2]}")
    phrase = sentence(rng, 60)
    return [
        None, "", " \n ", "tick " * 11, "tick " * 12, "tick " * 5000, "a b c d e f " * 2, "a b c d e f g " * 2 + "a b", fib[-1],
        f"{sentence(rng, 30)} {phrase} {phrase}\t{phrase} {sentence(rng, 20)}", "x y " * 9 + "x x y " * 9, sentence(rng, 3000),
        "ü 漢字\n" * 20 + "ü", " ".join(str(bin(i).count("1") % 2) for i in range(300)),
    ]


def test_runs_kernel():
    rng = random.Random(3)
    for _ in range(60):
        size, kinds = rng.randint(0, 120), rng.choice([1, 2, 3, 50])
        unit = [rng.randrange(kinds) for _ in range(rng.randint(1, 40))]
        texts = [[rng.randrange(kinds) for _ in range(size)], (unit * 9)[: 3 * size // 2], unit + unit + [kinds] + unit * 3]
        ids = np.array(sum(texts, []), np.int64)
        first = np.cumsum([0, *map(len, texts)])
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(ids, np.repeat(np.arange(3), np.diff(first))))))
        assert got == [(first[i] + s, n, q) for i, t in enumerate(texts) for s, n, q in plain_runs(t)]


def test_segments_hold_no_rare_word():
    ids = np.random.default_rng(2).integers(0, 60, 4000)
    place, part = periodic_runs.segments(ids, np.arange(4000) // 500)
    for i in range(part[-1] + 1 if len(part) else 0):
        mine = ids[place[part == i]]
        assert len(mine) >= 12 and min(collections.Counter(mine.tolist()).values()) >= 2


def test_pairs_in_pieces(monkeypatch):
    ids, row = np.concatenate([np.zeros(700, np.int64), np.arange(900) % 90]), np.repeat([0, 1], [700, 900])
    whole = [x.tolist() for x in periodic_runs.runs_of(ids, row)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 64)
    assert [x.tolist() for x in periodic_runs.runs_of(ids, row)] == whole == [[0, 700], [700, 900], [1, 90]]


def test_splitting_may_stop_early(monkeypatch):
    ids = np.array([x for i in range(300) for x in (i, i + 1)] + [1, 2, 3] * 9)
    row = np.zeros(len(ids), np.int64)
    whole = [x.tolist() for x in periodic_runs.runs_of(ids, row)]
    monkeypatch.setattr(periodic_runs, "MOST_COUNTS", 0)
    assert [x.tolist() for x in periodic_runs.runs_of(ids, row)] == whole and whole[2] == [3]


def test_periodic_runs(spark):
    docs = documents(spark, list(enumerate(periodic_texts())))
    want = []
    for r in docs.collect():
        w = words_of(r["text"])
        runs = plain_runs(w)
        want.append((r["doc_id"], len(w), runs, without_repeats(w, runs)))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(documents(spark, []).limit(0)).count() == 0


def test_op11_equals_brute_force(spark):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((r["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(without_repeats(w, runs).encode()).hexdigest()))
    got = entry.queries()["op11_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(x[1] for x in want)


def counts_of(text):
    text, w = text or "", words_of(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(windows)
    lines = [x for x in text.split("\n") if words_of(x)]
    stops = set(quality_rules.stop_forms(quality_rules.STOP_WORDS))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({j for i, x in enumerate(windows) if often[x] > 1 for j in range(i, i + 3)}),
        "n_stop_words": sum(x in stops for x in w), "n_lines": len(lines),
        "n_bullet_lines": sum(x.strip()[0] in "-*•" for x in lines), "n_ellipsis_lines": sum(x.rstrip().endswith(("...", "…")) for x in lines),
    }


def ruled_texts():
    rng = random.Random(9)
    prose = " ".join(f"{sentence(rng, 4)} the" for _ in range(40))
    return [
        None, "", "\n \t", "the " * 49, prose, f"{prose}\n" * 3, f"{sentence(rng, 60)}", " | ".join(sentence(rng, 60).split()),
        "\n".join(f"- the {sentence(rng, 5)}" for _ in range(12)), "\n".join(f"the {sentence(rng, 5)} ..." for _ in range(12)),
        " ".join(["the"] + ["w" * 40] * 2 + sentence(rng, 60).split()) * 30, "Für, the. El LA la, «the»" * 20, "a b c a b c", "a a a a",
        f"{prose}\n\n{prose}\n{prose} x", prose.replace(" ", " "), sentence(rng, 20_000), "tick tock " * 30_000,
    ]


def test_quality_rules(spark):
    docs = documents(spark, list(enumerate(ruled_texts())))
    texts = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    got = quality_rules.measured(docs).collect()
    want = []
    for (i, text), n in texts.items():
        c = counts_of(text)
        base = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        failed = [r.name for r in quality_rules.RULES if (r.least is not None and 100 * c[r.part] < r.least * c[r.whole])
                  or (r.most is not None and 100 * c[r.part] > r.most * c[r.whole])]
        want += [(i, *(c[k] for k in quality_rules.COUNTS), base, failed, not base and not failed)] * n
    assert pairs(got) == sorted(((w[0], *w) for w in want), key=repr)
    assert {name for r in got for name in r["failed"]} == {r.name for r in quality_rules.RULES}
    assert quality_rules.measured(documents(spark, []).limit(0)).count() == 0
    assert {tuple(r["failed"]) for r in quality_rules.measured(docs, []).collect()} == {()}


def test_quality_rules_stay_native(spark):
    plan = quality_rules.measured(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert plan.count("sort_array") == 3  # no column is worked out again where a later one uses it


def middle_texts():
    rng = random.Random(11)
    return [
        None, "", " ", "one", " one two \n", "a<P>b", "x <S y", "<M> at once", "ünï çødé 漢字 😀 ok " * 9, sentence(rng, 20_000),
        " ".join("w" * rng.randint(1, 3000) for _ in range(300)), *[sentence(rng, rng.randint(1, 40)) for _ in range(60)],
    ]


def test_rank_index():
    rng = np.random.default_rng(4)
    sizes = [1, 2, 3, 5000, 40_000]
    steps = [np.concatenate([[0], rng.integers(1, 9, n - 1)]) for n in sizes]
    steps[4][17_000:17_050] = 90_000
    offsets, first = np.concatenate([np.cumsum(s) for s in steps]), np.cumsum([0, *sizes])
    index = fill_middle.RankIndex(offsets, first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    assert (index.offset(text, np.arange(len(text)) - first[text]) == offsets).all()
    assert index.residual.dtype == np.int8 and len(index.lines[0]) < len(offsets) // 20


def test_boundaries():
    texts = middle_texts()
    column = pa.array(texts)
    offsets, first = fill_middle.boundaries(W.words(column, W.FIELDS), W.text_buffer(column)[1])
    for i, text in enumerate(texts):
        ends = np.cumsum([0, *(len(u.encode()) for u in re.findall(UNITS, text or ""))])
        assert offsets[first[i] : first[i + 1]].tolist() == ends.tolist()


def cut(i, text, rate=50, share=80):
    text, digest = text or "", hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(UNITS, text)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return (i, len(u), "plain", None, None, text)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < share:
        return (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate, share", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, rate, share):
    docs = documents(spark, list(enumerate(middle_texts())))
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = fill_middle.fill_in_middle(docs, rate=rate, suffix_first=share)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((cut(i, t, rate, share) for i, t in source), key=repr)
    back = made.select("doc_id", fill_middle.restored(made["output"], made["form"]))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in source), key=repr)
    assert fill_middle.fill_in_middle(documents(spark, []).limit(0)).count() == 0
