"""The table behind an ingest, and caps that None lifts."""

import pytest
from pyspark.sql import functions as F

from mnemora import session
from mnemora.operators import filters, lifecycle, ranking, stats
from mnemora.plans import ingest


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)


def tables(spark):
    memories = spark.createDataFrame(
        [(i, f"c{i}", f"l{i}", ["t"], 0.5, 0.5, None, 1, "k") for i in range(5)],
        "id long, content string, l0_abstract string, tags array<string>, confidence double, importance double, superseded_by long, version long, kept string"
    ).withColumn("updated_at", F.timestamp_seconds(F.lit(5)))
    upgrades = spark.createDataFrame([(0, "up0", "upl0", ["n"], 0.9), (1, "up1", "upl1", ["n"], 0.9)], "id long, content string, l0_abstract string, tags array<string>, confidence double")
    decided = spark.createDataFrame([(1, "merged", None, 0.7), (2, None, "new-1", 0.6), (99, "x", None, 0.1)], "id long, content string, superseded_by string, confidence double")
    inserts = spark.createDataFrame([("new-1", "fresh", 0.4, 1)], "id string, content string, confidence double, version long")
    return memories, inserts, upgrades, decided


def test_memory_table(spark):
    memories, inserts, upgrades, decided = tables(spark)
    table = ingest.memory_table(memories, inserts, 100, upgrades, decided)
    assert table.columns == memories.columns
    got = {r["id"]: (r["content"], r["l0_abstract"], r["confidence"], r["superseded_by"], r["version"], r["kept"]) for r in table.collect()}
    assert got == {
        "0": ("up0", "upl0", 0.9, None, 2, "k"), "1": ("merged", "upl1", 0.7, None, 2, "k"), "2": ("c2", "l2", 0.6, "new-1", 2, "k"),
        "3": ("c3", "l3", 0.5, None, 1, "k"), "4": ("c4", "l4", 0.5, None, 1, "k"), "new-1": ("fresh", None, 0.4, None, 1, None)}


def test_inserts_replace_themselves_and_the_table_is_read_again(spark, tmp_path):
    memories, inserts, upgrades, decided = tables(spark)
    relations = spark.createDataFrame([("0", "supports", "1")], "src_id string, relation_type string, target_id string")
    edges = spark.createDataFrame([("new-1", "contradicts", "2", None), ("0", "supports", "1", "again")], "src_id string, relation_type string, target_id string, context_label string")
    empty = memories.limit(0)
    done = ingest.Ingested(empty, empty, upgrades, empty.select("id", "content"), inserts, decided, edges, empty)
    first = [sorted(map(str, df.collect())) for df in ingest.commit(done, memories, relations, str(tmp_path), "b1", 100)]
    again = [sorted(map(str, df.collect())) for df in ingest.commit(done, memories, relations, str(tmp_path), "b1", 100)]
    assert first == again and len(first[0]) == 6 and len(first[1]) == 2
    table, links = ingest.commit(done, memories, relations, str(tmp_path), "b1", 100)
    second = ingest.commit(ingest.Ingested(empty, empty, upgrades.limit(0), empty.select("id", "content"), inserts, decided.limit(0), edges, empty),
                           table, links, str(tmp_path), "b2", 200)
    assert sorted(map(str, second[0].collect())) == first[0] and sorted(map(str, second[1].collect())) == first[1]


def test_none_lifts_caps(spark):
    rows = spark.createDataFrame([(i, "s", f"/p{i:03}", [f"t{i}"], "x" * 30_000) for i in range(120)], "id long, space_id string, project_path string, tags array<string>, content string").withColumns(
        {"conv_id": F.lit(1), "turn": F.col("id"), "tenant_id": F.lit("a")})
    assert filters.project_paths(rows).count() == 50 and filters.project_paths(rows, None).count() == 120
    assert stats.tag_stats(rows).count() == 100 and stats.tag_stats(rows, None).count() == 120
    assert lifecycle.cap_per_space(rows).count() == 50 and lifecycle.cap_per_space(rows, None).count() == 120
    assert ranking.select_recent(rows).count() == 6 and ranking.select_recent(rows, None, None).count() == 120
