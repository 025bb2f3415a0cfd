"""Connected components of a table of links, by alternating large and small stars.

Every round replaces each node's links by links to its least neighbour, first for the greater neighbours, then for the
smaller ones, until each component is one star. A round is two aggregations and two joins on the node, so nothing is
gathered in one place; its result is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _starred(links: DataFrame, both: bool) -> DataFrame:
    """Links (a, b) with a > b turned towards the least neighbour: of the greater nodes (``both``), or of the smaller."""
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if both:
        pairs = pairs.unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    joined = pairs.join(least, "node")
    if both:
        made = joined.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    else:
        made = joined.select(F.col("other").alias("a"), F.col("least").alias("b")).where("a != b").unionByName(
            least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return made.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and root (least node of its component) of every node of ``links`` (a, b); roots are rows, too."""
    state = saved(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links"
    )
    mark = None
    while True:
        new = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            break
        mark = new
        state = saved(_starred(_starred(state, True), False), "links")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
