"""Places of lines in files, read in ranges and as the files grow."""

import random

import pytest

from mnemora import session
from mnemora.sources import jsonl, transcripts
from mnemora.streaming import flows


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)


def content(seed, n):
    rng = random.Random(seed)
    return b"".join(bytes(rng.choice(["", "a" * rng.randint(0, 90), "ü漢", "{}\r"]), "utf-8") + b"\n" for _ in range(n))


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_once(tmp_path, monkeypatch, split):
    monkeypatch.setattr(jsonl, "READ_BYTES", 16)
    for tail in (b"", b"no feed"):
        data = content(1, 40) + tail
        (tmp_path / "x.jsonl").write_bytes(data)
        file = str(tmp_path / "x.jsonl")
        want, at = [], 0
        for line in data.split(b"\n")[: None if tail else -1]:
            want.append((at, line.removesuffix(b"\r")))
            at += len(line) + 1
        parts = jsonl.ranges({file: (0, len(data))}, split)
        assert [x for p in parts for x in jsonl.lines_of(file, p)] == want


def test_numbered_lines(spark, tmp_path):
    want = []
    for name, n in (("a", 50), ("b", 0), ("c", 3)):
        data = content(name, n)
        (tmp_path / f"{name}.jsonl").write_bytes(data)
        lines = data.split(b"\n")[:-1]
        want += [(f"{name}.jsonl", i, sum(len(x) + 1 for x in lines[:i]), x.decode().removesuffix("\r")) for i, x in enumerate(lines)]
    (tmp_path / "other.txt").write_text("x\n")
    read = jsonl.read_lines(spark, str(tmp_path), splitBytes=100)
    assert read.rdd.getNumPartitions() > 3
    rows = jsonl.numbered_lines(read)
    assert sorted((r["file"].split("/")[-1], r["line_no"], r["start"], r["value"]) for r in rows.collect()) == sorted(want)


def line(i, role="user"):
    return '{"type":"%s","uuid":"u%d","message":{"role":"%s","content":"%s"}}\n' % (role, i, role, f"text {i} " * 30)


def test_stream_follows_growing_files(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "s1.jsonl").write_text(line(0) + line(1, "assistant") + line(2)[:40])
    read = lambda: transcripts.read_transcripts(spark, str(source), True, splitBytes=200)
    first = flows.drain(read(), "append", folder=folder).collect()
    assert sorted((r["session_id"], r["uuid"]) for r in first) == [("s1", "u0"), ("s1", "u1")]
    with (source / "s1.jsonl").open("a") as out:
        out.write(line(2)[40:] + line(3))
    (source / "s2.jsonl").write_text(line(7))
    rows = flows.drain(read(), "append", folder=folder)
    assert sorted((r["session_id"], r["uuid"]) for r in rows.collect()) == [("s1", f"u{i}") for i in range(4)] + [("s2", "u7")]
    cursors = spark.createDataFrame([("s1", "u1")], "session_id string, uuid string")
    assert sorted(r["uuid"] for r in transcripts.after_cursor(rows, cursors).collect()) == ["u2", "u3", "u7"]
    assert {r["session_id"]: r["uuid"] for r in transcripts.new_cursors(rows).collect()} == {"s1": "u3", "s2": "u7"}


def test_small_files_share_tasks(spark, tmp_path):
    """The number of tasks does not grow with that of the files; ranges and places stay."""
    want = []
    for n in range(300):
        data = content(n, n % 7)
        (tmp_path / f"{n:03}.jsonl").write_bytes(data)
        want += [(str(tmp_path / f"{n:03}.jsonl"), i, x.removesuffix(b"\r").decode()) for i, x in enumerate(data.split(b"\n")[:-1])]
    rows = jsonl.read_lines(spark, str(tmp_path), splitBytes=100)
    assert 1 < rows.rdd.getNumPartitions() <= jsonl.TASKS + 1
    got = jsonl.numbered_lines(rows).select("file", "line_no", "value")
    assert sorted(map(tuple, got.collect())) == want
