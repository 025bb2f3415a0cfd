"""Rows of a ranked group whose text is nearly that of a better one, group by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import blocks, set_join

GROUP = 8192           # rows of a query that one task holds


def repeats(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets (distinct values each, best first) have a Jaccard similarity above ``threshold`` to an earlier one.

    Sets are put in order of rarity within the group; of two similar sets each holds, among its first few values, one that the
    other holds among its own. Only pairs that meet there are compared whole. Equal sets are compared once.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    value, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((value, counts[value], owner))
    owner, value = owner[order], value[order]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    first: dict[bytes, int] = {}
    out = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        out[i] = first.setdefault(value[bounds[i] : bounds[i + 1]].tobytes(), i) != i
    rank = np.arange(len(value)) - bounds[owner]
    lead = ~out[owner] & (rank <= np.floor(sizes[owner] * (1 - threshold) + 1e-9)) & (counts[value] > 1)
    holder, token = owner[lead], value[lead]
    order = np.lexsort((holder, token))
    holder, token = holder[order], token[order]
    left = np.searchsorted(token, token, "right") - np.arange(len(token)) - 1  # later holders of the same value
    one = np.repeat(holder, left)
    two = holder[np.repeat(np.arange(len(token)) + 1, left) + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)]
    fits = np.minimum(sizes[one], sizes[two]) >= threshold * np.maximum(sizes[one], sizes[two])
    tidy = [np.sort(value[a:b]) for a, b in zip(bounds, bounds[1:])]
    for i, j in np.unique(np.stack([one[fits], two[fits]], 1), axis=0).tolist():
        if not out[j]:
            shared = len(np.intersect1d(tidy[i], tidy[j], True))
            out[j] = shared / (sizes[i] + sizes[j] - shared) > threshold
    return out


def repeated(rows: DataFrame, threshold: float, most: int = GROUP) -> DataFrame:
    """(query_id, memory_id) of rows whose set is nearly that of a row of the same query with a lower place.

    ``rows``: query_id, memory_id, place, tokens (distinct longs, none null). A query's rows are held together where it has at
    ``most`` GROUP of them; else they are joined in parts.
    """
    if most > GROUP:
        keyed = stored(rows.withColumn("set_key", set_join.set_key(F.col("tokens").cast("array<string>"))), "keyed")
        sets = set_join.distinct_sets(keyed, ["query_id"], ("place",))
        first = set_join.similar_sets(sets, sets, ["query_id"], threshold, pick="first", order=("place",)).select(
            "query_id", F.col("left_key").alias("set_key"), F.col("place").alias("_first"))
        return keyed.join(first, ["query_id", "set_key"]).filter(F.col("_first") < F.col("place")).select("query_id", "memory_id")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        tokens = group.column("tokens").combine_chunks()
        flat, ends = blocks.plain(tokens.flatten()), np.cumsum(blocks.plain(pa.compute.list_value_length(tokens)))
        found = repeats(np.split(flat, ends[:-1]), threshold)
        return group.select(["query_id", "memory_id"]).filter(pa.array(found))

    kinds = dict(rows.dtypes)
    return rows.select("query_id", "memory_id", "place", "tokens").groupBy("query_id").applyInArrow(
        run, f"query_id {kinds['query_id']}, memory_id {kinds['memory_id']}")
