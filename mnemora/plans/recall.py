"""Recall for a table of queries: signal, query text, two-phase search, verdict, access counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as tx
from ..operators import ranking, stats
from ..session import cut_lineage
from .retrieval import Settings, search, text_leg, vector_leg


def level_value(signal: Column, which: int) -> Column:
    return (
        F.when(signal == "strong", P.RECALL_LEVELS["strong"][which])
        .when(signal == "medium", P.RECALL_LEVELS["medium"][which])
        .when(signal == "weak", P.RECALL_LEVELS["weak"][which])
        .otherwise(P.RECALL_LEVELS["none"][which])
    )


def recall_thresholds(queries: DataFrame, refine: bool = True) -> DataFrame:
    """Adds signal, min_score and gate. ``queries``: query_text, gate_yes (the model's yes, or skipped)."""
    yes = F.coalesce("gate_yes", F.lit(False))
    rows = queries.withColumn("signal", tx.recall_signal(tx.denoise_query(F.col("query_text"))))
    strong = F.when(yes, F.lit("strong")).otherwise(F.col("signal"))
    return rows.withColumn("min_score", level_value(strong, 0)).withColumn(
        "gate", level_value(strong, 1) if refine else F.lit(0.0))


def prepare(queries: DataFrame, refine: bool = True) -> DataFrame:
    """Cleaned queries with search text and thresholds; queries that are only injected text are dropped."""
    clean = queries.filter(tx.clean_message(F.col("query_text")) != "")
    judged = recall_thresholds(clean, refine)
    keywords = F.coalesce("keywords", F.array().cast("array<string>"))
    return judged.withColumn("query_text", tx.recall_query(tx.denoise_query(F.col("query_text")), keywords))


@dataclass
class RecallResult:
    memories: DataFrame
    verdicts: DataFrame
    hits: DataFrame


def recall(queries: DataFrame, memories: DataFrame, vectors: DataFrame, relations: DataFrame, as_of,
           max_results: int = 5, phase2_factor: int = 1, settings: Settings = Settings(),
           reranked: DataFrame | None = None, verdicts: DataFrame | None = None) -> RecallResult:
    """``queries``: query_id, query_text, embedding, access_keys, project_path, project_tags, keywords, gate_yes."""
    ready = prepare(queries, settings.strategy not in ("loose", "none"))
    few = replace(settings, limit=max_results)
    k = settings.fetch_factor * max_results * max(1, phase2_factor)
    legs = cut_lineage(vector_leg(ready, memories, vectors, k)), cut_lineage(text_leg(ready, memories, k))
    tagged = ready.filter(F.size("project_tags") > 0)
    project = search(tagged.withColumn("tags", F.col("project_tags")), memories, vectors, relations, as_of,
                     reranked, verdicts, few, legs=legs).results
    everywhere = search(ready.drop("tags"), memories, vectors, relations, as_of, reranked, verdicts,
                        replace(settings, limit=max_results * phase2_factor), legs=legs).results

    def ranked(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
        return df.select("query_id", "memory_id", "score", F.row_number().over(order).alias("rank"))

    asked = ready.select("query_id", F.lit(max_results).alias("max_results"), (F.size("project_tags") > 0).alias("has_project_tags"))
    found = ranking.two_phase_recall(ranked(project), ranked(everywhere), asked)
    judged = stats.recall_verdict(ready.select("query_id", "gate"), found)
    passed = found.join(judged.filter("should_recall").select("query_id"), "query_id", "left_semi")
    hits = passed.select(F.col("memory_id").alias("id"), F.col("query_id").alias("batch_id"))
    return RecallResult(passed, judged, hits)


def discarded_preview(discarded: DataFrame) -> DataFrame:
    """Discarded hits with at most 200 characters of content."""
    text = F.col("content")
    return discarded.withColumn("content", F.when(F.char_length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("…"))).otherwise(text))
