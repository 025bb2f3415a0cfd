"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader updates.

Features of a text: its words and runs of punctuation, and pairs of neighbours, hashed into ``DIM`` places; a pair of equal
neighbours is one feature whatever the word. A text's vector holds counts scaled to length 1, and its score is the logistic
of a sparse dot product. Labels are learned from at most ``SAMPLE`` rows, the first in order of a hash of doc_id; features
are made where the texts lie, and one task runs the updates in that order, so training is deterministic. The weights are
one value of 8 * DIM bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import words as W
from .common import released, table

BITS = 18
PIECE = 1 << 19
DIM = 1 << BITS
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
AGAIN = np.uint64(0x6A09E667F3BCC909)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of every nonzero feature, in order of row."""
    w = W.words(column, W.PROSE)
    row = w.row
    pair = W.grams(w.hash, 2)
    pair[w.hash[1:] == w.hash[:-1]] = AGAIN
    inside = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    shift = np.uint64(64 - BITS)
    keys = np.concatenate([(row << BITS) | (w.hash >> shift).astype(np.int64), (row[inside] << BITS) | (pair[inside] >> shift).astype(np.int64)])
    keys, counts = np.unique(keys, return_counts=True)
    row, place = keys >> BITS, keys & (DIM - 1)
    squares = np.bincount(row, counts.astype(float) ** 2, minlength=len(column))
    return row, place, counts / np.sqrt(squares[row])


def pieces(column: pa.Array):
    """Slices of a text column in order, of about PIECE bytes, with at least one text each."""
    ends = W.text_buffer(column)[1][1:]
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE, "right")))
        yield column.slice(start, stop - start)
        start = stop


def held_out(doc_id, folds: int, fold: int):
    """Whether the remainder of the row's checksum puts it outside the training rows; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, size: int) -> DataFrame:
    """At most ``size`` labelled rows outside the fold, the first in order of a hash of doc_id, with their texts."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    chosen = chosen.select("doc_id", F.col(label).cast("double").alias("label"), F.xxhash64("doc_id").alias("turn"))
    chosen = chosen.orderBy("turn", "doc_id", "label").limit(size)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _vectors(batches):
    for batch in batches:
        done = 0
        for texts in pieces(batch["text"]):
            row, place, value = features(texts)
            offsets = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                *(batch[name].slice(done, len(texts)) for name in ("turn", "doc_id", "label")),
                pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(value)),
            ], ["turn", "doc_id", "label", "place", "value"])
            done += len(texts)


def fitted(rows: pd.DataFrame, epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates over ``rows`` (label, place, value), in their order."""
    z, n = np.zeros(DIM), np.zeros(DIM)

    def weights(at):
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for y, at, x in zip(rows["label"], rows["place"], rows["value"]):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(DIM))


def trained(labelled: DataFrame) -> np.ndarray:
    """Weights from rows (turn, doc_id, label, text); zeros where there are none."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"weights": [fitted(rows.sort_values(["turn", "doc_id", "label"])).tobytes()]})

    vectors = labelled.select("turn", "doc_id", "label", "text").mapInArrow(
        released(_vectors), "turn long, doc_id long, label double, place array<int>, value array<double>"
    )
    found = vectors.groupBy(F.lit(0).alias("all")).applyInPandas(train, "weights binary").collect()
    return np.frombuffer(found[0]["weights"]) if found else np.zeros(DIM)


def scored(documents: DataFrame, weights: np.ndarray, name: str = "score") -> DataFrame:
    """``documents`` with the score in a last column ``name``, which replaces a column of that name; row for row.

    Null and empty texts have no features and score 0.5. Every row keeps its own result, so repeated rows stay. Only texts go to
    the Python workers, and only scores come back.
    """
    held = documents.sparkSession.sparkContext.broadcast(weights)

    def run(columns):
        for column in columns:
            totals = [np.zeros(0)]
            for texts in pieces(column):
                row, place, value = features(texts)
                totals.append(np.bincount(row, held.value[place] * value, minlength=len(texts)))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.concatenate(totals), -35, 35))))

    score = F.arrow_udf(released(run), "double", ArrowUDFType.SCALAR_ITER)
    kept = documents.drop(name)
    return kept.select("*", score("text").alias(name))


def unused(documents: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as tell it from the columns that are there."""
    while name.lower() in (c.lower() for c in documents.columns):
        name += "_"
    return name


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``documents``, all columns, with a score of THRESHOLD or more."""
    weights = trained(sample(documents, labels, "quality", FOLDS, HELD_OUT, SAMPLE))
    name = unused(documents, "score")
    return scored(documents, weights, name).where(F.col(f"`{name}`") >= THRESHOLD).drop(name)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` with score (higher: label 1 likelier)."""
    return scored(documents, trained(sample(documents, labels, "quality", FOLDS, HELD_OUT, SAMPLE)))


def op3(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality(documents, table(spark, sf_dir, "labels"))
    return rows.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
