"""Text rules as column expressions. Patterns are Unicode aware (``(?U)``); lengths are bytes where noted."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .columns import bound, cut, cut_bytes, lines, strip, strip_end, strip_start, total_of


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def _any_match(text: Column, patterns) -> Column:
    """True where any of the patterns matches, without case. A pattern is tried where one of its marks stands."""
    groups: dict[tuple, list[str]] = {}
    for pattern in patterns:
        groups.setdefault(("^",) if pattern.startswith("^") else P.MARKS.get(pattern, ()), []).append(pattern)
    # matching without case takes these four for i, s and k
    plain = F.when(F.rlike(text, F.lit("[\u0130\u0131\u017f\u212a]")), F.translate(text, "\u0130\u0131\u017f\u212a", "iisk")).otherwise(text)

    def hit(lower: Column) -> Column:
        any_hit = F.lit(False)
        for marks, group in groups.items():
            start = "^" if marks == ("^",) else ""
            match = F.rlike(text, F.lit(f"(?iU){start}(?:{P.any_of(group)})"))
            any_hit = any_hit | (total_of(lower, marks) & match if marks and not start else match)
        return any_hit

    return bound(F.lower(plain), hit)


# --- privacy -------------------------------------------------------------------------------------------------------

def redact_private(text: Column) -> Column:
    return F.regexp_replace(text, r"(?si)<private>.*?</private>", "[REDACTED]")


def fully_private(text: Column) -> Column:
    return strip(F.replace(redact_private(text), F.lit("[REDACTED]"), F.lit(""))) == ""


def is_sensitive(text: Column) -> Column:
    return F.rlike(text, F.lit("(?U)" + P.any_of(P.SENSITIVE)))


# --- noise ---------------------------------------------------------------------------------------------------------

def is_noise(text: Column) -> Column:
    return bound(strip(text), lambda trimmed: (
        (trimmed == "")
        | _any_match(trimmed, P.NOISE)
        | (trimmed.contains("DCP") & F.rlike(trimmed, F.lit("(?U)" + P.any_of(P.NOISE_CASED))))
    ))


def is_meta(text: Column) -> Column:
    """Tool chatter; text with a private block is exempt."""
    hit = bound(F.lower(text), lambda lower: total_of(lower, P.META_WORDS)) | _any_match(text, P.META)
    return hit & ~text.contains("<private>")


def is_compression_artifact(text: Column) -> Column:
    def found(lower: Column) -> Column:
        hit = total_of(lower, P.ARTIFACT_WORDS)
        for first, second in P.ARTIFACT_PAIRS:
            hit = hit | (lower.contains(first) & lower.contains(second))
        return hit

    return bound(F.lower(text), found)


# --- cleaning ------------------------------------------------------------------------------------------------------

def clean_message(text: Column, host: str | None = None) -> Column:
    """Injected blocks, phrases and lines removed; an unclosed block is cut to the end of its line.

    ``host``: product name in the host's own block tags; None takes any single word there.
    """
    name = _quoted(host) if host else "[A-Za-z][A-Za-z0-9]*"
    upper = _quoted(host.upper()) if host else "[A-Z][A-Z0-9]*"
    # a tag name with a blank in front has an empty name, so its block would close with "</>"
    tags = [(f"<{tag}", "</>") if tag.startswith(" ") else (f"<{tag}>", f"</{tag}>") for tag in P.MESSAGE_TAGS]
    own = [(f"<({name})-{part}>", f"</\\1-{part}>") for part in P.HOST_TAGS]
    blocks = [*[(_quoted(a), _quoted(b)) for a, b in tags], *own, (f"\\[({upper})-MEMORY\\]", "\\[/\\1-MEMORY\\]")]
    # no text without one of these changes before its lines are looked at
    marks = "|".join([*[opening for opening, _ in blocks], *map(_quoted, P.MESSAGE_PHRASES)])
    starts = "".join(sorted({re.escape(mark[0]) for mark in ("<", "[", *P.MESSAGE_PHRASES)}))

    def removed(text: Column) -> Column:
        for opening, closing in blocks:
            text = F.regexp_replace(text, f"(?s){opening}.*?{closing}", "")
            text = F.regexp_replace(text, f"{opening}[^\n]*", "")
        for phrase in P.MESSAGE_PHRASES:
            text = F.replace(text, F.lit(phrase), F.lit(""))
        return text

    marked = F.rlike(text, F.lit(f"(?=[{starts}])(?:{marks})"))
    rows = F.split(F.replace(F.when(marked, removed(text)).otherwise(text), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    kept = rf"(?U)^\s*+(?!{'|'.join(map(_quoted, P.DROPPED_LINE_STARTS))})\S"
    return strip(F.array_join(F.filter(rows, lambda line: F.rlike(line, F.lit(kept))), "\n"))


def strip_envelope(text: Column) -> Column:
    """Chat envelope and reminder sections removed. A section runs to a blank line or the next line in brackets.

    Lines are classed to one letter each (H header, B blank, O other bracket line, T text); the letters of skipped
    lines are found by two replacements over the string of letters.
    """
    def without(pattern: str, marks: tuple):
        return lambda t: F.when(total_of(t, marks), F.regexp_replace(t, "(?U)" + pattern, "")).otherwise(t)

    for pattern, marks in zip(P.ENVELOPE, P.ENVELOPE_MARKS):
        text = bound(text, without(pattern, marks))

    def kind(trimmed: Column) -> Column:
        header = F.lit(False)
        for head in P.ENVELOPE_HEADERS:
            header = header | F.startswith(trimmed, F.lit(head))
        return (F.when(header, F.lit("H")).when(trimmed == "", F.lit("B"))
                .when(F.startswith(trimmed, F.lit("[")), F.lit("O")).otherwise(F.lit("T")))

    def without_sections(rows: Column) -> Column:
        letters = F.array_join(F.transform(rows, lambda line: bound(strip(line), kind)), "")
        skipped = F.regexp_replace(letters, r"H|\G(?<=[HT])T", "x")
        skipped = F.split(F.regexp_replace(skipped, r"(?<=x)B", "x"), "")
        kept = F.zip_with(rows, skipped, lambda line, mark: F.when(mark != "x", line))
        return F.array_join(F.array_compact(kept), "\n")

    return strip_end(bound(text, lambda t: F.when(total_of(t, P.ENVELOPE_HEADERS), bound(lines(t), without_sections)).otherwise(
        F.replace(t, F.lit("\r\n"), F.lit("\n")))))


def user_request(text: Column) -> Column:
    """Body of the user-request block or the text; mode banners cut; injected texts give ''."""
    body = F.regexp_extract(text, r"(?s)<user-request>(.*?)</user-request>", 1)
    asked = F.when(F.rlike(text, F.lit(r"(?s)<user-request>.*?</user-request>")), strip(body)).otherwise(text)
    banner = F.regexp_replace(asked, r"(?s)^\[(?:search-mode|analyze-mode)\].*?\n---\n?", "")
    line_cut = strip(F.regexp_replace(asked, r"(?U)^\[(?:search-mode|analyze-mode)\]\s*\n", ""))
    plain = F.when((banner != asked) & (strip(banner) != ""), strip(banner)).otherwise(line_cut)
    return F.when(F.rlike(plain, F.lit("(?U)" + P.any_of(P.INJECTED_STARTS))), F.lit("")).otherwise(plain)


def sanitize(text: Column, limit: int = 3000) -> Column:
    clean = F.regexp_replace(text, r"(?s)<[\w-]+[^>]*>.*?</[\w-]+>", "")
    clean = F.regexp_replace(clean, r"<[\w-]+[^>]*/>", "")
    clean = strip(F.regexp_replace(clean, r"(?U)\s+", " "))
    return F.when(F.char_length(clean) <= limit, clean).otherwise(
        F.concat(F.substring(clean, 1, limit), F.lit("…[truncated]")))


def clean_transcript(text: Column, hosts=("memory",)) -> Column:
    """Reminder and host blocks removed, white space folded. ``hosts``: product names in block tags."""
    names = "|".join(["system-reminder", *[f"{h}-[a-z0-9_-]+" for h in hosts]])
    clean = F.regexp_replace(text, rf"(?si)<({names})\b[^>]*>.*?</\1>", "")
    clean = F.regexp_replace(clean, rf"(?i)<({names})\b[^>]*/>", "")
    return strip(F.regexp_replace(clean, r"(?U)\s+", " "))


def denoise_query(text: Column, limit: int = 200) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"(?s)```.*?```", "")
    clean = F.regexp_replace(strip(clean), r"(?U)\s+", " ")
    return F.when(F.char_length(clean) > limit, F.concat(F.substring(clean, 1, limit), F.lit("...(truncated)"))
                  ).otherwise(clean)


def recall_query(denoised: Column, keywords: Column) -> Column:
    """Joined keywords, unless there are none or they are shorter than half of the query."""
    joined = F.array_join(keywords, " ")
    use = (F.size(keywords) > 0) & (F.char_length(joined) >= F.floor(F.char_length(denoised) / 2))
    return F.when(use, joined).otherwise(denoised)


# --- scores --------------------------------------------------------------------------------------------------------

def quality_score(text: Column) -> Column:
    size = F.octet_length(text)
    score = F.lit(0.5)
    for bound in (50, 100, 200):
        score = score + F.when(size > bound, 0.05).otherwise(0.0)
    for pattern, bonus in P.QUALITY:
        score = score + F.when(F.rlike(text, F.lit("(?U)" + pattern)), bonus).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.1)), F.lit(1.0))


def utility_score(text: Column) -> Column:
    trimmed = strip(text)
    size = F.octet_length(trimmed)
    long = F.greatest(
        F.lit(0.7),
        F.when(F.rlike(trimmed, F.lit("[0-9]")), 0.85).otherwise(0.0),
        F.when(F.rlike(trimmed, F.lit(r"(?U)\s\p{Lu}")), 0.8).otherwise(0.0),
        F.when(size > 60, 0.75).otherwise(0.0),
    )
    return F.when(size <= 5, 0.2).when(size <= 20, 0.3).otherwise(long)


def recall_signal(query: Column) -> Column:
    return (
        F.when(F.rlike(query, F.lit("(?U)" + P.any_of(P.RECALL_STRONG))), F.lit("strong"))
        .when(F.rlike(query, F.lit("(?U)" + P.any_of(P.RECALL_MEDIUM))), F.lit("medium"))
        .when(F.rlike(query, F.lit("(?U)" + P.any_of(P.RECALL_WEAK))), F.lit("weak"))
        .otherwise(F.lit("none"))
    )


def content_kind(text: Column) -> Column:
    headed = text.startswith("# ") | text.startswith("## ") | text.contains("\n# ") | text.contains("\n## ")
    many_words = F.rlike(text, F.lit(r"(?U)^\s*+(?:\S++\s++){499}+\S"))  # 500; the rest is not read
    return (
        F.when(F.octet_length(text) > 80_000, F.lit("large"))
        .when(F.regexp_count(text, F.lit(P.ROLE_LINE)) >= 3, F.lit("conversation"))
        .when(~many_words & ~headed, F.lit("note"))
        .otherwise(F.lit("structured"))
    )


def keyword_intent(text: Column) -> tuple[Column, Column]:
    """(asks to save, asks to recall)."""
    lower = F.lower(text)
    return total_of(lower, P.SAVE_WORDS), total_of(lower, P.RECALL_WORDS)


# --- sets ----------------------------------------------------------------------------------------------------------

def normalize_dedup(text: Column) -> Column:
    """Letters and digits lower-cased, everything else one blank, no blank at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+", " "))


def grams(text: Column, n: int) -> Column:
    """All character n-grams in order, by a look-ahead that matches at every position."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _never_empty(tokens: Column) -> Column:
    """Empty sets become {''}: two empty sets are equal, an empty and a filled one share nothing."""
    return F.when(F.size(tokens) == 0, F.array(F.lit(""))).otherwise(tokens)


def trigram_set(text: Column) -> Column:
    return _never_empty(F.array_distinct(grams(normalize_dedup(text), 3)))


def word_set(text: Column) -> Column:
    """Case-sensitive words without punctuation at their ends."""
    words = F.transform(
        F.split(text, r"(?U)\s+"),
        lambda w: F.regexp_replace(w, r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def content_set(text: Column) -> Column:
    """Character pairs where the text has CJK letters, lower-cased words otherwise."""
    cjk = F.rlike(text, F.lit("[\u4E00-\u9FFF\u3400-\u4DBF\u3040-\u30FF]"))
    pairs = F.when(F.char_length(text) < 2, F.array(text)).otherwise(grams(text, 2))
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    return _never_empty(F.array_distinct(F.when(cjk, pairs).otherwise(words)))


def preference_keywords(text: Column) -> Column:
    """Pairs of CJK letters and lower-cased words of three letters or more."""
    pairs = F.regexp_extract_all(text, F.lit("(?=([\u4e00-\u9fff]{2}))"), F.lit(1))
    words = F.transform(F.regexp_extract_all(text, F.lit("[a-zA-Z_]{3,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.concat(pairs, words))


def jaccard(left: Column, right: Column, both_empty: float = 0.0) -> Column:
    """Shared over united elements of two arrays without duplicates."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(both_empty)).otherwise(shared / union)


def word_jaccard(left: Column, right: Column) -> Column:
    return jaccard(word_set(left), word_set(right), 0.0)


def trigram_jaccard(left: Column, right: Column) -> Column:
    return jaccard(trigram_set(left), trigram_set(right))


def set_marks(tokens: Column) -> Column:
    """Size of a set and 256 bits that its tokens set, in four words: enough for ``may_be_similar`` to rule pairs out."""
    def word(hashes: Column, place: int) -> Column:
        def mark(bits: Column, value: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(value, 2), F.lit(64)).cast("int"))
            return F.when(F.pmod(value, F.lit(4)) == place, bits.bitwiseOR(bit)).otherwise(bits)

        return F.aggregate(hashes, F.lit(0).cast("bigint"), mark)

    return bound(F.transform(tokens, lambda t: F.xxhash64(t)), lambda hashes: F.struct(
        F.size(hashes).alias("size"), F.array(*[word(hashes, n) for n in range(4)]).alias("bits")))


def may_be_similar(left: Column, right: Column, threshold: float) -> Column:
    """False only for the marks of sets whose Jaccard similarity is at most ``threshold``: they differ in at least as many tokens as
    their bits or sizes do, and similar ones differ in few."""
    bits = sum((F.bit_count(left["bits"][n].bitwiseXOR(right["bits"][n])) for n in range(4)), F.lit(0))
    most = (left["size"] + right["size"]) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return F.greatest(bits, F.abs(left["size"] - right["size"])) <= most


# --- cutting -------------------------------------------------------------------------------------------------------

def split_sections(text: Column) -> Column:
    """Sections that start at ``# `` or ``## `` lines; a blank start belongs to the first section."""
    whole = F.when(F.endswith(text, F.lit("\n")), text).otherwise(F.concat(text, F.lit("\n")))

    def first_joined(parts: Column) -> Column:
        blank_start = (strip(parts[0]) == "") & (F.size(parts) > 1)
        joined = F.concat(F.array(F.concat(parts[0], F.try_element_at(parts, F.lit(2)))), F.slice(parts, F.lit(3), F.size(parts)))
        return F.when(blank_start, joined).otherwise(parts)

    return F.when(strip(text) == "", F.array(text)).otherwise(bound(F.split(whole, r"(?<=\n)(?=##? )", -1), first_joined))


def split_overflow(text: Column, limit: int = 3000) -> Column:
    """(first, second): the first part ends before the last ``## `` line that keeps it within ``limit`` characters,
    else after the character that starts within the first ``limit`` bytes."""
    parts = F.split(text, r"(?<=\n)(?=## )", -1)
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("best"))

    def step(state, part):
        trimmed = state["total"] + F.char_length(strip_end(part))
        trimmed = F.when(strip(part) == "", F.lit(0)).otherwise(trimmed)
        total = state["total"] + F.char_length(part)
        return F.struct(total.alias("total"), F.when(trimmed.between(1, limit), total).otherwise(state["best"]).alias("best"))

    best = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["best"]
    clipped = cut_bytes(text, limit)
    partial = F.octet_length(clipped) < F.least(F.octet_length(text), F.lit(limit))
    by_bytes = F.char_length(clipped) + F.when(partial, 1).otherwise(0)
    place = F.when(best > 0, best).otherwise(by_bytes)
    first = strip_end(F.substring(text, F.lit(1), place))
    second = strip_start(F.substring(text, place + 1, F.char_length(text)))
    return F.struct(first.alias("first"), second.alias("second"))


def has_section(text: Column, topic: Column) -> Column:
    """Any ``## `` line that ends with the topic; an empty topic never matches."""
    wanted = strip(topic)
    return (wanted != "") & F.exists(lines(text), lambda l: F.startswith(l, F.lit("## ")) & F.endswith(l, wanted))


def truncate_sentence(text: Column, limit: int) -> Column:
    """Cut after the last sentence end that fits, else at the limit."""
    head = F.substring(text, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^.*[。！？\n]", 0)
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.when(sentence != "", sentence).otherwise(head), F.lit("...")))


def preview(text: Column) -> Column:
    """At most 100 bytes, else 97 bytes and dots."""
    return F.when(F.octet_length(text) > 100, F.concat(cut_bytes(text, 97), F.lit("..."))).otherwise(text)


# --- paths ---------------------------------------------------------------------------------------------------------

def canonical_path(path: Column) -> Column:
    """``C:\\x`` becomes ``/mnt/c/x``; other paths stay."""
    drive = F.lower(F.regexp_extract(path, r"(?s)^([a-zA-Z]):[\\/](.*)$", 1))
    rest = F.translate(F.regexp_extract(path, r"(?s)^([a-zA-Z]):[\\/](.*)$", 2), "\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), drive, F.lit("/"), rest)).otherwise(path)


def scope_tag(prefix: str, identity: Column) -> Column:
    """Prefix and the first 16 hex digits of the identity's hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(identity, 256), 1, 16))


__all__ = [n for n in dir() if not n.startswith("_")]
