"""Registered queries of this subpackage and their SQL."""

from . import (
    bpe, chat_format, decontaminate, embedding_dedup, fill_middle, licenses, ngram_join, periodic_runs, quality, quality_rules,
    substring_dedup, token_files, toxicity,
)

QUERIES = {
    "op1_chat_formatting": chat_format.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_quality_classifier": quality.op3,
    "op4_token_files": token_files.op4,
    "op5_toxicity": toxicity.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_license_scan": licenses.op7,
    "op8_bpe_round_trip": bpe.op8,
    "op9_embedding_near_dedup": embedding_dedup.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_quality_rules": quality_rules.op12,
    "op13_fill_in_middle": fill_middle.op13,
}
ORACLES = {
    "op1_chat_formatting": chat_format.OP1_SQL,
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
    "op7_license_scan": licenses.OP7_SQL,
    "op9_embedding_near_dedup": embedding_dedup.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_fill_in_middle": fill_middle.OP13_SQL,
}
