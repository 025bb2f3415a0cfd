"""What operators move or hold: less than their inputs where the result needs less."""

import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mnemora import session
from mnemora.functions import text as tx
from mnemora.operators import diversity, reconcile, set_join, stats
from mnemora.plans import retrieval


def test_eval_joins_texts_behind_the_best(spark):
    results = spark.createDataFrame([(1, n, n / 100, n % 3) for n in range(50)] + [(1, 99, 9.0, 7)], "query_id int, memory_id int, score double, text_id int")
    texts = spark.createDataFrame([(0, "zero"), (1, "QUite"), (2, "two")], "text_id int, content string")
    wanted = spark.createDataFrame([(1, "qu", "password"), (2, "qu", "")], "query_id int, should_contain string, should_not_contain string")
    rows = stats.retrieval_eval(results, texts, wanted, 2)
    assert sorted(rows.select("query_id", "results", "passed").collect()) == [(1, 2, True), (2, 0, False)]  # 49 and 48: QUite, zero
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan[plan.index("content"):]  # texts meet rows that the window has cut


def test_admission_asks_and_searches_equal_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    shapes = [rng.normal(size=4).tolist() for _ in range(6)]
    memories = spark.createDataFrame([(n, f"t{n % 2}", n) for n in range(60)], "id bigint, tenant_id string, s bigint").withColumn(
        "updated_at", F.timestamp_seconds(F.lit(1700000000) + F.col("s") * 86400)).drop("s")
    known = spark.createDataFrame([(n, shapes[n // 2 % 6]) for n in range(60)], "id bigint, embedding array<double>")
    facts = spark.createDataFrame(
        [(n, f"t{n % 2}", "some words here", 4, 0.5, shapes[n % 6] if n < 30 else None, None) for n in range(31)],
        "fact_id bigint, tenant_id string, l0_abstract string, llm_confidence int, admission_weight double, embedding array<double>, conversation string")
    seen, search = [], reconcile.vector_topk

    def counted(queries, rows, *rest):
        seen.append((queries.count(), rows.count()))
        return search(queries, rows, *rest, query_bound=2)

    monkeypatch.setattr(reconcile, "vector_topk", counted)
    got = {r["fact_id"]: r for r in reconcile.admission_score(facts, memories, known, "2024-08-01 00:00:00").collect()}
    assert seen == [(6, 12)] and len(got) == 31
    assert all(abs(got[n]["max_similarity"] - 1) < 1e-9 for n in range(30)) and got[30]["novelty"] == got[30]["recency"] == 1.0
    first = {(n % 2, n // 2 % 6): n for n in reversed(range(60))}
    for n in range(30):
        idle = (1722470400 - 1700000000 - first[n % 2, n % 6] * 86400) // 86400
        assert abs(got[n]["recency"] - (1 - np.exp(-idle / 30))) < 1e-12


def test_set_join_in_parts_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(set_join, "PART", 16)
    monkeypatch.setattr(set_join, "CELLS", 200)
    rng = random.Random(5)
    sets = [(n, f"g{min(n % 9, 3)}", sorted({f"w{rng.randrange(14 if n % 2 else 9)}" for _ in range(rng.randint(1, 9))})) for n in range(240)]
    left, right = sets[:120], sets[120:]

    def alike(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    def frame(rows, name):
        return spark.createDataFrame(rows, f"{name} int, g string, tokens array<string>")

    want = {}
    for n, g, a in left:
        near = sorted((-alike(a, b), m) for m, h, b in right if g == h and alike(a, b) > 0.6)
        if near:
            want[n] = (near[0][1], min(m for _, m in near))
    best = set_join.best_match(frame(left, "left_id"), frame(right, "right_id"), ["g"], 0.6)
    assert {r["left_id"]: r["right_id"] for r in best.collect()} == {n: w[0] for n, w in want.items()} and len(want) > 50
    keyed = [frame(rows, "id").withColumn("set_key", set_join.set_key(F.col("tokens"))) for rows in (left, right)]
    first = set_join.similar_sets(set_join.distinct_sets(keyed[0], ["g"]), set_join.distinct_sets(keyed[1], ["g"], ("id",)), ["g"], 0.6,
                                  pick="first", order=("id",)).select("g", F.col("left_key").alias("set_key"), F.col("id").alias("hit"))
    assert {r["id"]: r["hit"] for r in keyed[0].join(first, ["g", "set_key"]).collect()} == {n: w[1] for n, w in want.items()}


def test_diversity_holds_only_the_best_rows_until_queries_are_settled(spark, monkeypatch):
    rng = random.Random(2)
    words = [" ".join(f"w{rng.randrange(40)}" for _ in range(8)) for _ in range(12)]
    rows = [(q, m, rng.randrange(40) / 40, words[0] if q == 1 and m < 90 else rng.choice(words) + f" x{m % 5}") for q in (1, 2) for m in range(120)]
    hits = spark.createDataFrame(rows, "query_id int, memory_id int, score double, content string")
    want = []
    for query in (1, 2):
        line = sorted((-s, m, set(c.split())) for q, m, s, c in rows if q == query)
        new = [(s / 2 if any(len(t & c) > 0.85 * len(t | c) for _, _, t in line[:n]) else s, m) for n, (s, m, c) in enumerate(line)]
        want += [(query, m, -s) for s, m in sorted(new)[:6]]
    monkeypatch.setattr(diversity, "GROUP", 64)
    seen, judge = [], diversity.repeated
    monkeypatch.setattr(retrieval, "repeated", lambda rows, t, most: (seen.append(most), judge(rows, t, most))[1])
    texts = spark.createDataFrame([(q * 1000 + m, c) for q, m, s, c in rows], "memory_id int, content string")
    own = hits.withColumn("memory_id", F.col("query_id") * 1000 + F.col("memory_id")).drop("content")
    got = retrieval.diversity(own, retrieval.Settings(limit=6), texts, 8).collect()
    assert sorted((r["query_id"], r["memory_id"] - 1000 * r["query_id"], r["score"]) for r in got) == sorted(want)
    assert seen[0] == 8 and seen[-1] > 64 or seen == [8, 64]


def test_marks_rule_out_only_sets_that_are_not_similar(spark):
    rng = random.Random(4)
    base = [f"t{n}" for n in range(60)]
    sets = [base[: rng.randint(1, 60)] + [f"x{rng.randrange(40)}" for _ in range(rng.randint(0, 9))] for _ in range(60)] + [
        [f"{n}-{m}" for m in range(40)] for n in range(20)] + [[""], ["", "a"]]
    rows = spark.createDataFrame([(n, sorted(set(s))) for n, s in enumerate(sets)], "id int, tokens array<string>").withColumn(
        "marks", tx.set_marks(F.col("tokens")))
    left, right = (rows.toDF("id" + s, "tokens" + s, "marks" + s) for s in "ab")
    judged = left.crossJoin(right).select(
        tx.may_be_similar(F.col("marksa"), F.col("marksb"), 0.6).alias("may"), (tx.jaccard(F.col("tokensa"), F.col("tokensb")) > 0.6).alias("is")).collect()
    assert all(r["may"] for r in judged if r["is"]) and sum(r["is"] for r in judged) > 100
    assert sum(r["may"] for r in judged) < 0.6 * len(judged)


def test_dedup_marks_texts_once_and_compares_trigrams_of_few_pairs(spark):
    """Sets were made again for every pair of a fact and a candidate, and texts that are no candidates were hashed."""
    facts = spark.createDataFrame(
        [(1, 1, "the cat sat on the mat today", 0.5), (2, 1, "nothing like it", 0.5), (3, 1, "The CAT", 0.5), (4, 2, "...", 0.5)],
        "fact_id int, batch_id int, l0_abstract string, importance double").withColumn("source_text", F.lit(None).cast("string"))
    memories = spark.createDataFrame(
        [(10, "the cat sat on the mat todax", "a", 0.9), (11, "the cat sat on the mat toda", "b", 0.1), (12, "x", "Nothing, like it!", 0.1), (13, "!!", "c", 0.9),
         (14, "y", "z", 0.1)], "id int, l0_abstract string, content string, importance double")
    candidates = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 13, 1)], "batch_id int, memory_id int, place int")
    made = reconcile.exact_dedup(facts, memories, candidates)
    got = {r["fact_id"]: (r["tier"], r["memory_id"], r["outcome"]) for r in made.collect()}
    assert got == {1: (2, 11, "upgrade"), 2: (1, 12, "upgrade"), 3: (2, 10, "skip"), 4: (3, 13, "skip")}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "bit_count" in plan


def test_stored_tables_of_large_rows_have_small_row_groups(spark):
    """Spark's reader holds a row group of few rows as a whole; segments of an index came in groups of as many rows as a task had."""
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda n: F.sha2(F.concat_ws("/", "id", n), 256)), "")
    made = session.stored(spark.range(60, numPartitions=1).select("id", F.array(text.cast("binary")).alias("x")), "wide")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made.inputFiles()]
    groups = [f.row_group(n).num_rows for f in files for n in range(f.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= 40
