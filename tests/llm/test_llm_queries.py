"""Registered queries of the subpackage against their SQL, and the pipeline against its parts."""

import hashlib
import re

import compare
import numpy as np
import pytest
from test_llm_operators import hit_words, linked
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from mnemora.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, oracle, name):
    problem, _ = compare.compare(spark, oracle, name, entry.queries(), entry.oracle_sql(), SF)
    assert problem is None, problem


def test_pipeline(spark):
    """Every stage's decisions hold in what the next one gets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        docs = corpus_pipeline.saved(stage(spark, before, SF), f"test-stage-{number}")
        assert docs.columns == before.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert corpus_pipeline.run(spark, SF).count() == counts[-1]
    assert "pipeline" in entry.queries()


def test_pipeline_equals_brute_force(spark):
    """Behind the trained classifier, every stage by plain Python."""
    first = corpus_pipeline.saved(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), "brute")
    docs = sorted((r["doc_id"], r["text"] or "") for r in first.collect())
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(fold))
        k = corpus_pipeline.SHINGLE
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = linked(sets, lambda a, b: a and b and 100 * len(a & b) >= corpus_pipeline.PERCENT * len(a | b))
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    cut, sources, shorter = [(d, t.split()) for d, t in docs], {}, []
    for d, w in cut:
        for i in range(len(w) - 49):
            sources.setdefault(tuple(w[i : i + 50]), d)
    for (d, text), (_, w) in zip(docs, cut):
        gone = {j for i in range(len(w) - 49) if sources[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        shorter.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else text))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokenizer, want = Tokenizer.from_file(bpe.vocabulary_path()), []
    for d, text in shorter:
        if not hit_words(text, items)[1]:
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == want and len(want) < len(sets)
