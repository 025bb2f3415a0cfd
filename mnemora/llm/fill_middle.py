"""Fill-in-middle transformation, with a piecewise-linear learned index from ranks of boundaries to offsets.

A text is cut into units: blanks and the word behind them, and blanks at its end. ``RankIndex`` holds the boundaries of all
texts of a batch as lines, each of which predicts the offset of a boundary from its rank within ``BOUND`` bytes, and one byte
of residual a boundary. A line starts as a whole text; where its error is too great it is halved, until all are bounded.
Cuts are ranks drawn from a hash of the document's id; an offset is predicted and corrected by its residual, exactly.

The middle moves to the end, in one of two orders, between signs that no such text holds, so ``restored`` needs nothing but
the output and its form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
BOUND = 127


class RankIndex:
    """Offsets of boundaries by rank; those of text i are ``offsets[first[i]:first[i + 1]]``, at least one each."""

    def __init__(self, offsets: np.ndarray, first: np.ndarray):
        self.first = first
        self.residual = np.zeros(len(offsets), np.int8)
        begin, end, fitted = first[:-1], first[1:], []
        while len(begin):
            ranks = np.maximum(end - begin - 1, 1)
            lines = np.stack([begin, offsets[begin], offsets[end - 1] - offsets[begin], ranks])
            size = end - begin
            line = np.repeat(np.arange(len(begin)), size)
            at = np.arange(len(line)) + np.repeat(begin - (np.cumsum(size) - size), size)
            error = offsets[at] - self._predicted(lines[:, line], at)
            worst = np.maximum.reduceat(np.abs(error), np.cumsum(size) - size)
            good = worst <= BOUND
            fitted.append(lines[:, good])
            here = good[line]
            self.residual[at[here]] = error[here]
            middle = (begin + end)[~good] // 2
            begin, end = np.concatenate([begin[~good], middle]), np.concatenate([middle, end[~good]])
        lines = np.concatenate(fitted, axis=1) if fitted else np.zeros((4, 0), np.int64)
        self.lines = lines[:, np.argsort(lines[0])]

    @staticmethod
    def _predicted(lines: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, base, rise, ranks = lines
        return base + (at - start) * rise // ranks

    def offset(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Offset of the boundary of each rank in each text."""
        at = self.first[text] + rank
        line = np.searchsorted(self.lines[0], at, "right") - 1
        return self._predicted(self.lines[:, line], at) + self.residual[at]


def boundaries(w: W.Words, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets in each text of its start, the end of every unit, and where those of each text begin; edges: of texts."""
    last = np.where(w.count > 0, w.end[np.maximum(w.first[1:] - 1, 0)] if len(w.end) else 0, edges[:-1])
    blank_end = edges[1:] > last
    first = np.concatenate([[0], np.cumsum(w.count + 1 + blank_end)])
    offsets = np.zeros(int(first[-1]), np.int64)
    row = w.row
    offsets[first[row] + 1 + np.arange(len(row)) - w.first[row]] = w.end - edges[row]
    offsets[first[1:][blank_end] - 1] = np.diff(edges)[blank_end]
    return offsets, first


def _cut(batches):
    for batch in batches:
        w = W.words(batch["text"], W.FIELDS)
        data, edges = W.text_buffer(batch["text"])
        offsets, first = boundaries(w, edges)
        n = np.diff(first) - 1
        index = RankIndex(offsets, first)
        form = batch["form"].to_pylist()
        moved = np.flatnonzero([f != "plain" for f in form])
        draws = np.stack([batch[c].to_numpy(zero_copy_only=False)[moved] % (n[moved] + 1) for c in ("first_draw", "second_draw")])
        low, high = (index.offset(moved, r) for r in (draws.min(axis=0), draws.max(axis=0)))
        out, prefix_chars, middle_chars = batch["text"].fill_null("").to_pylist(), [None] * len(form), [None] * len(form)
        for i, a, b in zip(moved.tolist(), low.tolist(), high.tolist()):
            text = data[edges[i] : edges[i + 1]].tobytes()
            prefix, middle, suffix = (x.decode("utf-8", "replace") for x in (text[:a], text[a:b], text[b:]))
            prefix_chars[i], middle_chars[i] = len(prefix), len(middle)
            lead = (PREFIX, prefix, SUFFIX, suffix) if form[i] == "psm" else (SUFFIX, suffix, PREFIX, prefix)
            out[i] = "".join((*lead, MIDDLE, middle))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(n, pa.int64()), batch["form"], pa.array(prefix_chars, pa.int64()),
             pa.array(middle_chars, pa.int64()), pa.array(out, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the seed and the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(documents: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output; one row per row.

    Of 100 documents about ``rate`` are cut, and of 100 of these about ``suffix_first`` have the suffix first (spm), the others
    the prefix (psm). Null and empty texts, and texts that hold one of the three signs, stay plain. Rows with equal doc_id are
    cut at the same draws. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    signs = [F.contains(text, F.lit(sign)) for sign in (PREFIX, SUFFIX, MIDDLE)]
    plain = (text == "") | signs[0] | signs[1] | signs[2] | (third % 100 >= rate)
    form = F.when(plain, "plain").when(fourth % 100 < suffix_first, "spm").otherwise("psm")
    rows = documents.select("doc_id", text.alias("text"), form.alias("form"), first.alias("first_draw"), second.alias("second_draw"))
    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(_cut, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from."""
    parts = F.split(output, "<[PSM]>", 4)
    one, two, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
    WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
cut AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
