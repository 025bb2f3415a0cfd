"""Recall gate in chunks and the block-wise noise learner against their rules row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import session
from mnemora.streaming import flows, gates


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)


def requests():
    rng = random.Random(4)
    rows = []
    for key, n, span in (("hot", 1500, 12_000), ("dense", 400, 400), ("rare", 30, 900_000), ("one", 1, 10)):
        rows += [(key, rng.choice(["s", "", None]), i, rng.randrange(span), rng.choice([None, 0.1, 0.9, float("nan")])) for i in range(n)]
    rows += [("edge", "s", i, ts, 0.0) for i, ts in enumerate([3570, 3599, 3600, 3629, 3630, 7199, 7200, 7200, 90_000, 200_000])]
    return rows


def frame(spark, rows):
    made = spark.createDataFrame(rows, "tenant_id string, session_id string, query_id long, s long, similarity double")
    return made.withColumn("ts", F.timestamp_seconds("s"))


def row_by_row(rows, last=None):
    last, out = dict(last or {}), []
    named = [(t if not s else f"{t}:{s}", ts, q, x) for t, s, q, ts, x in rows]
    for key, ts, q, x in sorted(named, key=lambda r: r[:3]):
        last[key], reason = gates.judge(last.get(key), ts, x)
        out.append((key, q, ts, reason == "ok", reason))
    return sorted(out), last


def test_gate_equals_row_by_row(spark):
    rows = requests()
    verdicts, state = gates.gated(gates.gate_rows(frame(spark, rows)))
    want, last = row_by_row(rows)
    assert sorted(map(tuple, verdicts.collect())) == want and {r["gate_key"]: r["last"] for r in state.collect()} == last
    assert {w[4] for w in want} == {"ok", "rate_limited", "similarity_too_high"}
    assert gates.recall_gate_batch(frame(spark, rows).limit(0)).count() == 0


def test_gate_goes_on_from_its_state(spark, tmp_path):
    rows = sorted(requests(), key=lambda r: r[3])
    body, last, cut = gates.recall_gate(str(tmp_path)), {}, [0, 300, 301, 1200, len(rows)]
    for number, (a, b) in enumerate(zip(cut, cut[1:])):
        want, last = row_by_row(rows[a:b], last)
        for _ in range(2):  # a batch that runs again replaces itself
            assert sorted(map(tuple, body(frame(spark, rows[a:b]), number).collect())) == want


def test_chunk_function():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ts = np.unique(rng.integers(7200, 10_800, rng.integers(1, 900)))
        first, last = gates.chunk_function(ts)
        for before in (None, *range(7170, 7200)):
            passes = gates.chunk_passes(ts, before)
            at = 0 if before is None else int(np.searchsorted(first, before + 30))
            assert (passes[-1] if passes else None) == (int(last[at]) if at < len(first) else None)


def test_gate_goes_on_within_a_chunk(spark, tmp_path):
    """A batch ends within an hour; what passes in the rest of it counts for the hour that follows."""
    seconds = [[0, 1795], [1801, 1826, 3590, 3601, 3620, 3625, 7190], [7205, 7221]]
    rows = [("t", "s", ts, ts, 0.0) for part in seconds for ts in part]
    body, at, got = gates.recall_gate(str(tmp_path)), 0, []
    for number, part in enumerate(seconds):
        got += map(tuple, body(frame(spark, rows[at : at + len(part)]), number).collect())
        at += len(part)
    assert sorted(got) == row_by_row(rows)[0]


def noise(n=900, dims=6):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dims)) + 2 * rng.normal(size=(8, dims))[rng.integers(0, 8, n)]
    x[::50] = 0
    return np.round(x, 3)


def one_by_one(rows, fixed, same, size):
    learned, out = [], []
    for v in map(gates.unit, rows):
        known = any(round(float(v @ w), 6) >= same for w in (*fixed, *learned))
        out.append(not known)
        if not known:
            learned = [*learned, v][-size:]
    return out


@pytest.mark.parametrize("size, same", [(3, 0.8), (20, 0.9), (200, 0.95)])
def test_leaders(monkeypatch, size, same):
    rows = noise()
    fixed = np.stack([gates.unit(v) for v in rows[5:8]])
    unit = np.stack([gates.unit(v) for v in rows])
    monkeypatch.setattr(gates, "BLOCK", 64)
    for prototypes in (fixed, fixed[:0]):
        want = one_by_one(rows, prototypes, same, size)
        assert gates.Leaders(prototypes, size, same).learn(unit).tolist() == want and 0 < sum(want) < len(want)


def test_noise_learner_in_batches(spark, tmp_path):
    rows = noise(300)
    table = [(f"t{i % 2}", i, v.tolist()) for i, v in enumerate(rows)]
    want = sorted((t, s, x) for t in ("t0", "t1") for (_, s, _), x in zip(
        [r for r in table if r[0] == t], one_by_one([r[2] for r in table if r[0] == t], [gates.unit(rows[4])], 0.9, 10)))
    make = lambda part: spark.createDataFrame(part, "tenant_id string, seq long, embedding array<double>")
    assert sorted(map(tuple, gates.noise_learner_batch(make(table), [rows[4].tolist()], 0.9, 10).collect())) == want
    body, got = gates.noise_learner(str(tmp_path), [rows[4].tolist()], 0.9, 10), []
    for number, part in enumerate((table[:40], table[40:41], table[41:220], table[220:])):
        got += map(tuple, body(make(part), number).collect())
    assert sorted(got) == want


def test_streams_run_several_triggers(spark, tmp_path):
    rows = sorted(requests(), key=lambda r: r[3])
    for a, b in ((0, 500), (500, 1000), (1000, len(rows))):
        frame(spark, rows[a:b]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = flows.drain(stream, "append", gates.recall_gate(str(tmp_path / "state")))
    assert len(list((tmp_path / "state").glob("batch=*"))) == 3 and sorted(map(tuple, got.collect())) == row_by_row(rows)[0]
