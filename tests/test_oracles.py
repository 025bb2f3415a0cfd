"""Registered queries against their SQL on the smallest scale factor.

The whole list takes minutes; ``MNEMORA_ALL=1`` runs it, otherwise one query of each kind.
"""

import os

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = [
    "decay_scores", "evaluate_tiers_low_floors", "lifecycle_run", "filter_memories", "visible_to_each", "upsert_memories",
    "set_visibility", "memory_stats", "tag_stats", "recall_verdict", "pack_budget", "two_phase_recall", "chain_tail",
    "chain_members", "merge_groups", "fuzzy_pairs", "vector_topk", "vector_topk_blocks", "text_topk", "text_topk_blocks",
    "mmr_diversity", "search", "cross_reconcile", "clean_message", "strip_envelope", "split_sections", "prepare_facts",
    "admission_gate", "exact_dedup", "apply_decisions_updates", "share_results", "auto_share", "profile_text",
    "apply_induction_reinforced", "parse_transcripts", "webhooks_to_memories", "recall_gate_batch", "stream_timeline",
]
NAMES = list(entry.queries()) if os.environ.get("MNEMORA_ALL") else SOME


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, oracle, name):
    problem, _ = compare.compare(spark, oracle, name, entry.queries(), entry.oracle_sql(), SF)
    assert problem is None, problem


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
