"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add long expressions behind a one-row generator, so later steps read them instead of inlining them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


#: What ``(?U)\s`` matches.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, expression) -> Column:
    """``expression(value)`` with a value that is worked out once, however often the expression names it."""
    return F.transform(F.array(value), expression)[0]


def lines(text: Column) -> Column:
    """Lines of a text; a closing newline starts no further line."""
    return bound(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def two_digits(value: Column) -> Column:
    """A double as text with two digits behind the point, rounded by its exact binary value (halves to even) as C does.

    ``format_string`` rounds what the double is printed as: 0.995, which is stored a little below, would give 1.00. For values
    up to 4: a value in the hundredth around an odd number of 200ths is moved away from that tie, to the side on which it lies.
    """
    size = F.abs(value)
    units = (size * float(2**60)).cast("bigint").cast("decimal(19,0)")
    nearest = F.rint(size * 200).cast("decimal(4,0)")
    side = F.signum(units * F.lit(200).cast("decimal(3,0)") - nearest * F.lit(2**60).cast("decimal(19,0)"))
    even = F.when(nearest % 4 == 1, -1).otherwise(1)
    moved = size + F.when(nearest % 2 == 0, 0.0).otherwise(F.when(side == 0, even).otherwise(side) * 0.001)
    return F.format_string("%.2f", moved * F.when(value < 0, -1.0).otherwise(1.0))


def strip(text: Column) -> Column:
    """Trim white space of every kind at both ends."""
    return F.trim(text, F.lit(WHITE))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def strip_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE))


def cut(text: Column, limit: int, mark: str = "...") -> Column:
    """Text of at most ``limit`` characters, the mark included when something is cut."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit - len(mark)), F.lit(mark))
    )


def bytes_to_text(raw: Column) -> Column:
    """Bytes as text; what is left of a character cut in half becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


def cut_bytes(text: Column, keep: int) -> Column:
    """First ``keep`` bytes, without a character that would be cut in half."""
    return F.regexp_replace(bytes_to_text(F.substring(F.encode(text, "UTF-8"), 1, keep)), "\uFFFD+$", "")


def total_of(text: Column, words) -> Column:
    """True where any of the literal words occurs."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit
