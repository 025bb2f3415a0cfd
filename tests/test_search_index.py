"""Stored indexes of texts and vectors, and the search per space, against brute force on small tables."""

import collections
import math
import random

import numpy as np
import pytest

from mnemora import session
from mnemora.operators import diversity, graph, ranking, text_search, vector_index, vectors
from mnemora.plans import retrieval


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)


def grams(text):
    return [text[i : i + n] for n in (2, 3, 4) for i in range(len(text) - n + 1)]


def bm25(rows, query, store):
    """Score of every text of the store that shares an n-gram with the query."""
    mine = [r for r in rows if (r["store"] or "") == store]
    best = collections.defaultdict(float)
    for field in ("content", "l0_abstract"):
        bags = {r["id"]: collections.Counter(grams((r[field] or "").lower())) for r in mine}
        average = sum(sum(b.values()) for b in bags.values()) / len(bags) if bags else 0
        df = collections.Counter(g for b in bags.values() for g in b)
        for i, bag in bags.items():
            size = sum(bag.values())
            total = sum(math.log(1 + (len(mine) - df[g] + 0.5) / (df[g] + 0.5)) * bag[g] * 2.2 / (bag[g] + 1.2 * (0.25 + 0.75 * size / average))
                        for g in set(grams(query.lower())) if g in bag)
            best[i] = max(best[i], total)
    return {i: s for i, s in best.items() if s > 0}


WORDS = ["alpha", "beta", "Gamma", "delta", "漢字", "naïve", "😀", "zeta zeta", "x", "memory", "store", "spark"]


def texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(90):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25)))
        rows.append((i, [None, "a", "b", "c"][i % 4], text if i % 13 else None, text[:7], ["k1", "k2"][i % 2],
                     [None, "/srv", "/srv/app", "/opt"][i % 4], ["global", "private"][i % 3 == 0], "noise"))
    rows.append((500, "big", " ".join(rng.choice(WORDS) for _ in range(60_000)), "memory", "k1", None, "global", "n"))
    return spark.createDataFrame(rows, "id long, store string, content string, l0_abstract string, access_key string, project_path string, scope string, score string")


def test_text_index(spark, tmp_path):
    memories = texts(spark)
    rows = [r.asDict() for r in memories.collect()]
    asked = [("q1", "alpha beta 漢字", ["a", "b"]), ("q2", "MEMORY 😀 store", ["", "big", "a"]), ("q3", "", ["a"]), ("q4", None, ["b"]),
             ("q5", "zeta", ["nowhere"]), ("q6", "x naïve", ["a", "b", "c", "", "big", "a"])]
    queries = spark.createDataFrame(asked, "query_id string, query_text string, stores array<string>")
    made = text_search.text_index(memories, path=str(tmp_path))
    assert made.segments.count() >= 5
    for index in (made, text_search.read_index(spark, str(tmp_path))):
        for k, bound in ((3, 256), (200, 2)):
            want = []
            for q, text, stores in asked:
                found = {i: s for store in set(stores) for i, s in bm25(rows, text or "", store).items()}
                want += [(q, i, round(s, 6)) for i, s in sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]]
            got = text_search.search_index(queries, index, k, bound).collect()
            assert sorted((r["query_id"], r["memory_id"]) for r in got) == sorted(w[:2] for w in want)
            assert {tuple(r)[:2]: r["text_score"] for r in got} == pytest.approx({w[:2]: w[2] for w in want}, abs=2e-6)


def test_text_filters_and_empty(spark):
    memories = texts(spark)
    queries = spark.createDataFrame(
        [(1, "alpha beta", ["a", "b", "c", ""], ["k1"], None, None, None), (2, "alpha beta", ["a", "b", "c", ""], ["k1", "k2"], "/srv", "global", None),
         (3, "alpha beta", ["a", "b", "c", ""], ["k1", "k2"], None, None, "only"), (4, "alpha beta", ["a", "b", "c", ""], ["k2"], None, "private", "exclude")],
        "query_id long, query_text string, stores array<string>, access_keys array<string>, project_path string, scope string, global_scope string")
    rows = {r["id"]: r.asDict() for r in memories.collect()}
    got = collections.defaultdict(set)
    for r in text_search.text_topk(queries, memories, 1000).collect():
        got[r["query_id"]].add(r["memory_id"])
    allowed = {
        1: lambda r: r["access_key"] == "k1",
        2: lambda r: r["scope"] == "global" and (r["project_path"] or "/srv").startswith("/srv"),
        3: lambda r: r["project_path"] is None, 4: lambda r: r["access_key"] == "k2" and r["scope"] == "private" and r["project_path"],
    }
    scored = {i for store in ("", "a", "b", "c") for i in bm25(list(rows.values()), "alpha beta", store)}
    for q, rule in allowed.items():
        assert got[q] == {i for i in scored if rule(rows[i])} and got[q]
    assert text_search.text_topk(queries.limit(0), memories, 5).count() == 0
    assert text_search.text_topk(queries, memories.limit(0), 5).count() == 0


def unit(x):
    x = np.asarray(x, float)
    return x / max(np.linalg.norm(x), 1e-300)


def vector_rows(n=240, dims=12):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, dims))
    out = []
    for i in range(n):
        v = centres[i % 6] + 0.3 * rng.normal(size=dims)
        out.append((i, [float(np.float32(x)) for x in (v if i % 40 else v * 0)], ["a", "b", "big", "big"][i % 4], ["k1", "k2"][i % 2]))
    return out + [(900, out[5][1], "b", "k1"), (901, None, "a", "k1")]


@pytest.mark.parametrize("segment", [8, 10_000])
def test_vector_index(spark, tmp_path, segment):
    data = vector_rows()
    rows = spark.createDataFrame(data, "memory_id long, embedding array<float>, store string, access_key string")
    rng = np.random.default_rng(6)
    asked = [(q, [float(x) for x in rng.normal(size=12)], stores, keys) for q, (stores, keys) in enumerate(
        [(["a"], ["k1", "k2"]), (["big", "b"], ["k2"]), (["big"], ["k1", "k2"]), (["none"], ["k1"]), (["a", "b", "big"], ["k1"])] * 3)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>, stores array<string>, access_keys array<string>")
    vector_index.vector_index(rows, str(tmp_path), segment)
    index = vector_index.read_index(spark, str(tmp_path))
    for k, least in ((5, None), (500, 0.1)):
        want = set()
        for q, v, stores, keys in asked:
            found = [(-round(float(unit(v) @ unit(w)), 6), i) for i, w, store, key in data if w is not None and store in stores and key in keys]
            want |= {(q, i, -s + 0.0) for s, i in sorted(found)[:k] if least is None or -s >= least}
        got = {(r["query_id"], r["memory_id"], r["score"]) for r in vector_index.search_index(queries, index, k, least).collect()}
        assert got == want
    plan = index.segments.join(spark.createDataFrame([(0, 1)], "shard int, segment long"), ["shard", "segment"])
    assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("segment, least", [(8, 0.85), (8, 0.3), (10_000, 0.85), (10_000, -1.0)])
def test_neighbours(spark, segment, least):
    data = [r for r in vector_rows() if r[1] is not None]
    rows = spark.createDataFrame([r[:3] for r in data], "memory_id long, embedding array<float>, store string")
    want = set()
    for i, v, store, _ in data:
        found = [(-round(float(unit(v) @ unit(w)), 6), j) for j, w, other, _ in data if other == store]
        want |= {(i, j, -s + 0.0) for s, j in sorted(found)[:4] if -s >= least}
    got = {tuple(r) for r in vectors.similar_neighbours(rows, least, 4, cell_rows=segment).collect()}
    assert got == want


def test_pairs_are_rarely_multiplied_whole():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 64))
    x[::50] = x[1::50] + 0.1 * rng.normal(size=(30, 64))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = vector_index.Pairs(x, x, 0.85)
    found = [pairs.found(slice(i, i + 200)) for i in range(0, 1500, 200)]
    full = vector_index.similarities(x, x)
    assert [np.concatenate(c).tolist() for c in zip(*found)] == [*(c.tolist() for c in np.nonzero(full >= 0.85)), full[full >= 0.85].tolist()]
    assert pairs.whole < 0.01 * full.size


def test_no_cap(spark):
    rows = spark.createDataFrame([(i // 5, i) for i in range(20)], "g int, i int")
    assert ranking.top_n(rows, ["g"], ["i"], None).count() == 20 and ranking.top_n(rows, ["g"], ["i"], 2).count() == 8
    candidates = spark.createDataFrame([(1, 0, 0.5)], "query_id long, memory_id long, score double")
    relations = spark.createDataFrame([(0, i) for i in range(1, 31)], "src_id long, target_id long")
    memories = spark.createDataFrame([(i,) for i in range(31)], "id long")
    assert graph.expand_relations(candidates, relations, memories, None).count() == 30
    assert graph.expand_relations(candidates, relations, memories).count() == 20


def test_spaces_on_one_scale(spark):
    hits = spark.createDataFrame(
        [(1, "s", 0.8, 1, 4.0), (1, "s", 0.8, 2, 2.0), (1, "t", 1.0, 3, 0.0), (2, "s", 0.8, 4, 0.1)],
        "query_id long, space_id string, weight double, memory_id long, score double")
    got = sorted((r["query_id"], r["memory_id"], r["score"]) for r in retrieval.merge_spaces(hits, None).collect())
    assert got == [(1, 1, 0.8), (1, 2, 0.4), (1, 3, 0.0), (2, 4, 0.8)]


def test_queries_by_space(spark):
    queries = spark.createDataFrame([(1, "u", "x"), (11, "u", None), (2, "v", "")], "query_id long, tenant_id string, agent_id string")
    spaces = spark.createDataFrame([("u", "s", 1.0), ("u", "1:1s", 0.8), ("v", "s", 0.6)], "user_id string, space_id string, weight double")
    got = {r["search_id"]: (r["query_id"], r["stores"], set(r["access_keys"]), r["weight"]) for r in retrieval.space_queries(queries, spaces).collect()}
    assert len(got) == 5
    assert got["1:1s"] == (1, ["s"], {"s|global", "s|private:x", "s|shared:s", "s|shared:1:1s"}, 1.0)
    assert got["2:11s"] == (11, ["s"], {"s|global", "s|shared:s", "s|shared:1:1s"}, 1.0)
    assert got["1:2s"] == (2, ["s"], {"s|global", "s|shared:s"}, 0.6)


def test_repeats():
    rng = np.random.default_rng(9)
    base = [rng.choice(400, 60, False) for _ in range(5)]
    sets = [np.unique(np.concatenate([b[rng.integers(0, 12):], rng.integers(1000, 1100, rng.integers(0, 6))])) for b in base for _ in range(8)]
    sets = [np.asarray(s, np.int64) for s in [*sets, sets[3][::-1], [7], [7], [8, 9], *rng.integers(0, 30, (20, 1))]]
    for threshold in (0.5, 0.85):
        want = [any(len(set(a) & set(b)) / len(set(a) | set(b)) > threshold for a in map(np.ndarray.tolist, sets[:j])) for j, b in
                enumerate(map(np.ndarray.tolist, sets))]
        assert diversity.repeats(sets, threshold).tolist() == want and any(want)
