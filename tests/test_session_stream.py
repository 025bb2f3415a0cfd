"""Topics folded as a stream leave the memories that folding all of them at once leaves."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora import session
from mnemora.operators import session_memory
from mnemora.streaming import flows

AS_OF = 1722470400


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)
    flows.use_rocksdb(spark)


def tables(spark):
    rng = random.Random(6)
    topics = [(f"s{rng.randrange(5)}", n, "t", f"topic {rng.randrange(60)}", " ".join(rng.choice("abcdefg") * rng.randint(1, 60) for _ in range(rng.randint(1, 40))),
               rng.choice([None, "over"]), rng.choice([None, "detail"]), rng.choice([None, "WORK", "EMOTIONAL"]), "x", rng.choice(["private", "global"]),
               ["a", "b", f"c{n % 7}"], "src", None) for n in range(90)]
    made = spark.createDataFrame(topics, "session_id string, topic_no long, tenant_id string, topic string, summary string, overview string, detail string, "
                                 "memory_type string, category string, scope string, tags array<string>, ingest_source string, project_path string")
    stored = spark.createDataFrame(
        [(1, "s0", "WORK", "## x topic 1\nold", "l0", "o", "d", ["z"], 5), (2, "s0", "WORK", "newer", "l0b", "o", "d", ["y"], 9), (3, "s1", "EMOTIONAL", "felt", "l0c", "o", "d", [], 5)],
        "id long, session_id string, kind string, content string, l0_abstract string, l1_overview string, l2_content string, tags array<string>, s long")
    return made, stored.withColumn("created_at", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("max_tags", [None, 4])
def test_stream_equals_batch(spark, tmp_path, max_tags):
    topics, memories = tables(spark)
    rows = topics.orderBy("topic_no").collect()
    for a, b in ((0, 20), (20, 21), (21, 60), (60, 90)):
        spark.createDataFrame(rows[a:b], topics.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(topics.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = flows.drain(flows.keyed_session_memory(stream, memories, AS_OF, max_tags), "append", lambda b, n: b.withColumn("batch", F.lit(n))).collect()
    assert len({r["batch"] for r in made}) >= 3
    last = {r["id"]: r for r in sorted(made, key=lambda r: r["batch"])}
    want = session_memory.append_topics(memories, topics, AS_OF, max_tags).collect()
    columns = ["session_id", "kind", "content", "l0_abstract", "parent_id", "tags"]
    assert {i: [r[c] for c in columns] for i, r in last.items()} == {r["id"]: [r[c] for c in columns] for r in want}
    assert any(r["parent_id"] for r in want) and {"2", "3"} <= set(last) and "1" not in last
