"""Chains of memories against walking them link by link."""

import random

import pytest

from mnemora import session
from mnemora.operators import graph, session_memory


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    session.configure(spark)


def walked(nodes, links):
    nxt = {a: b for a, b in links.items() if a != b and a in nodes and b in nodes}
    out = {}
    for i in nodes:
        seen, at = [], i
        while at in nxt and at not in seen:
            seen.append(at)
            at = nxt[at]
        out[i] = seen[-1] if at in seen else at
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chain_tail(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    links = {i: i + 1 for i in range(25)}  # a long chain
    links |= {i: rng.choice([*range(25, 64), i]) for i in range(30, 50)}  # others, with cycles, loops and missing ends
    rows = [(a, "continued_by", b) for a, b in links.items()] + [(3, "continued_by", 50), (4, "supports", 1)]
    relations = spark.createDataFrame(rows, "src_id long, relation_type string, target_id long")
    memories = spark.createDataFrame([(i,) for i in nodes], "id long")
    want = walked(set(nodes), links)
    assert {r["id"]: r["tail_id"] for r in graph.chain_tail(memories, relations).collect()} == want
    few = spark.createDataFrame([(0,), (7,), (33,), (33,), (999,)], "id long")
    assert sorted(map(tuple, graph.chain_tail(memories, relations, few).collect())) == [(i, want[i]) for i in (0, 7, 33)]
    assert graph.chain_tail(memories, relations.limit(0)).count() == 60


def test_cross_session_tail_stays_in_its_tenant(spark):
    memories = spark.createDataFrame(
        [(1, "a", None, "global", "global", "session_ingest"), (2, "b", None, "global", "global", "session_ingest"),
         (3, "b", None, "global", "global", "other")],
        "id long, tenant_id string, project_path string, visibility string, scope string, source string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.3]), (3, [1.0, 0.0])], "id long, embedding array<double>")
    relations = spark.createDataFrame([(1, "continued_by", 3), (2, "continued_by", 3)], "src_id long, relation_type string, target_id long")
    topics = spark.createDataFrame([(9, "b", None, [1.0, 0.0]), (8, "c", None, [1.0, 0.0])], "query_id long, tenant_id string, project_path string, embedding array<double>")
    got = session_memory.cross_session_tail(topics, memories, vectors, relations).collect()
    assert [(r["query_id"], r["hit_id"], r["tail_id"]) for r in got] == [(9, 2, 3)]
