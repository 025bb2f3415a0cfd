"""Quality rules: a table of thresholds compiled into one projection of column expressions.

``RULES`` names ratios of counts and the range in which each may lie, as whole percents, so that every comparison is one of
integers. ``compiled`` turns the table into a boolean per rule and ``measured`` evaluates all of them, with the counts they
need, row by row where the texts lie: no user functions, no shuffle.

Counts of a text: words (runs of anything but ASCII blanks), code points in words, symbols, stop words, lines with a word,
those equal to an earlier line, those that begin with a bullet or end with an ellipsis, and the words covered by three-word
windows that the text holds twice or more. For these, 36 bits of a window's hash and its place are one number; the numbers are
sorted and neighbours of equal hash are likely repeats. The likely ones alone are sorted as texts, so the count is exact and
the work n log n in the words of a text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1

# Frequent function words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "are", "this", "at", "have"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "auf", "sich", "für", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "pas", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "una", "su", "para", "al"],
}


class Rule(NamedTuple):
    """100 * ``part`` must lie from ``least`` to ``most`` times ``whole``; a None bound is none, a zero whole passes."""

    name: str
    part: str
    whole: str
    least: int | None
    most: int | None


# Thresholds, in the order in which failures are reported.
RULES = [
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 4, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
          "n_bullet_lines", "n_ellipsis_lines"]


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII blanks, in order."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def compiled(rules: list[Rule]) -> dict[str, Column]:
    """For each rule of the table whether a row of counts keeps it."""
    out = {}
    for rule in rules:
        holds = F.lit(True)
        if rule.least is not None:
            holds &= F.col(rule.part) * 100 >= F.col(rule.whole) * rule.least
        if rule.most is not None:
            holds &= F.col(rule.part) * 100 <= F.col(rule.whole) * rule.most
        out[rule.name] = holds
    return out


def stop_forms(stop_words: dict[str, list[str]]) -> list[str]:
    """Stop words as they stand in texts: small or with a capital, bare or with a stop or comma behind."""
    words = {w for listed in stop_words.values() for w in listed}
    return sorted(form + sign for w in words for form in (w, w[0].upper() + w[1:]) for sign in ("", ".", ","))


def counted(documents: DataFrame, stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """doc_id and ``COUNTS`` (long) of every row; null texts have none of anything. Other columns are ignored."""
    cut = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text", words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda s: F.rlike(s, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    word = lambda i: F.get("words", i)
    whole = F.slice("words", 1, F.greatest(F.size("words") - (WINDOW - 1), F.lit(0)))
    marks = F.transform(whole, lambda w, i: F.shiftleft(F.xxhash64(w, word(i + 1), word(i + 2)), PLACE_BITS).bitwiseOR(i.cast("long")))
    many = lambda sign: F.size(F.filter("lines", lambda s: F.rlike(s, F.lit(sign))))
    flat = cut.select(
        "doc_id", "words", F.sort_array(marks).alias("marks"), F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"), F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).alias("n_symbols"),
        F.size(F.filter("words", lambda w: w.isin(stop_forms(stop_words)))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        many(r"^[\x20\x09-\x0D]*[-*•]").alias("n_bullet_lines"), many(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$").alias("n_ellipsis_lines"),
    )
    hashed = lambda k: F.shiftright(F.get("marks", k), PLACE_BITS)
    alike = F.filter("marks", lambda m, k: (hashed(k) == hashed(k - 1)) | (hashed(k) == hashed(k + 1)))
    likely = flat.withColumn("windows", F.sort_array(F.transform(alike, lambda m: F.struct(
        F.array_join(F.slice("words", m.bitwiseAND(PLACES).cast("int") + 1, WINDOW), " ").alias("window"), m.bitwiseAND(PLACES).cast("int").alias("place")))))
    near = lambda k: F.get("windows", k)["window"]
    placed = likely.withColumn("places", F.sort_array(F.transform(
        F.filter("windows", lambda x, k: (x["window"] == near(k - 1)) | (x["window"] == near(k + 1))), lambda x: x["place"])))
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))),
        F.lit(0), lambda total, n: total + n)
    return placed.withColumn("n_repeat_words", covered).select("doc_id", *[F.col(c).cast("long").alias(c) for c in COUNTS])


def measured(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, ``COUNTS``, base_failed, failed (names of the broken rules, in order of the table) and kept; row for row.

    Null, empty and blank texts have no words and fail by length; repeated rows and null ids keep their own results.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    broken = F.filter(F.array(*[F.when(~holds, F.lit(name)) for name, holds in compiled(rules).items()]), lambda x: x.isNotNull())
    out = counted(documents).select("doc_id", *COUNTS, base.alias("base_failed"), (broken if rules else F.array().cast("array<string>")).alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op12(spark, sf_dir: str) -> DataFrame:
    rows = measured(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{form}'" for form in stop_forms(STOP_WORDS))
    bounds = [
        f"100 * {rule.part} {sign} {bound} * {rule.whole}" for rule in RULES
        for sign, bound in ((">=", rule.least), ("<=", rule.most)) if bound is not None]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS t(i) WHERE len(w) >= {WINDOW}),
repeats AS (
  SELECT doc_id, sum(n) AS n FROM (
    SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM windows WHERE n > 1)
  GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[{SYMBOLS}]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop_words, len(l) AS n_lines,
    len(list_filter(l, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda s: regexp_matches(s, '([.][.][.]|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM d LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts)
"""


OP12_SQL = _sql()
