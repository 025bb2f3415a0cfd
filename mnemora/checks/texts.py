from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as tx
from ..functions import times
from ..operators import chunking
from .registry import query
from .views import AS_OF


def q(text):
    return "'" + text.replace("'", "''") + "'"


def alt(patterns):
    return q(P.any_of(patterns))


def has_any(column, words):
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


# Every text of the driver's tables; a line with marks the rules look for is put in front, chosen by row number.
LINES = [
    "<private>my Secret\nkey</private> rest", "<PRIVATE>all</PRIVATE>", "mail a.b@c.org or 10.0.0.12", "password: hunter2",
    "token = abc", "card 4111111111111111", "Thanks!", "hello", "git commit -m x", "Compression #12 removed", "extracted 4 facts",
    "task_id: bg_1", "<system-reminder>\nnoise\n</system-reminder>after", "<thinking>open\nnext line", "[search-mode] body\n---\nask me",
    "[system-reminder]\nskip me\nand me\n\nkeep", "[Compressed conversation section]\nx\n[other] y", "<!-- c\nd -->z", "<dcp-note>\nplain",
    "# Title\ntext\n## Part one\nmore\n## Part two\nend", "\nuser: a\nassistant: b\nuser: c\n", "remember last time we discussed the deploy of our project",
    "how should we implement this", "记住 因此 2024年 12月", "```code\nblock``` <b>tag</b>  two   spaces", "Version 3.14 costs 20% in USD, MyClass",
    "- item one\n- item two", "## 2024-05-01 10:00 topic a\nbody", "<user-request> do it </user-request>", "你好！", "compressed 12 messages", "<x-y a=1>in</x-y> out <br/>",
    "",
]
ARRAY_SQL = "[" + ", ".join(q(l) for l in LINES) + "]"
CORPUS = f"""raw AS (SELECT doc_id AS id, text AS body FROM documents UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations UNION ALL SELECT 9000000 + page_id, html FROM pages),
corpus AS (SELECT id, concat(({ARRAY_SQL})[1 + id % {len(LINES)}], chr(10), body) AS text, ({ARRAY_SQL})[1 + id % {len(LINES)}] AS lead FROM raw)"""


def corpus(t):
    raw = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("body")).unionByName(
        t.conversations.select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("body"))
    ).unionByName(t.pages.select((F.lit(9000000) + F.col("page_id")).alias("id"), F.col("html").alias("body")))
    lead = F.array(*[F.lit(l) for l in LINES])[(F.col("id") % len(LINES)).cast("int")]
    # the driver's tables are single row groups, which would leave the text rules to one core
    return raw.select("id", F.concat(lead, F.lit("\n"), "body").alias("text"), lead.alias("lead"))


def simple(name, column, sql, of=("text", "lead")):
    """Check a row function on whole texts and on the leading lines."""
    names = [f"on_{c}" for c in of]
    body = ", ".join(f"{sql(c)} AS {n}" for c, n in zip(of, names))

    @query(name, f"WITH {CORPUS} SELECT id, {body} FROM corpus")
    def run(t):
        return corpus(t).select("id", *[column(F.col(c)).alias(n) for c, n in zip(of, names)])


def strip_sql(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def fold(c):
    return f"regexp_replace({c}, '\\s+', ' ', 'g')"


def redact_sql(c):
    return f"regexp_replace({c}, '(?si)<private>.*?</private>', '[REDACTED]', 'g')"


simple("redact_private", tx.redact_private, redact_sql)
simple("fully_private", tx.fully_private, lambda c: f"({strip_sql(f'replace({redact_sql(c)}, {q('[REDACTED]')}, {q('')})')} = '')")
simple("detect_sensitive", tx.is_sensitive, lambda c: f"regexp_matches({c}, {alt(P.SENSITIVE)})")
simple("noise_regex", tx.is_noise, lambda c: f"({strip_sql(c)} = '' OR regexp_matches({strip_sql(c)}, {q('(?i)' + P.any_of(P.NOISE))}) OR regexp_matches({strip_sql(c)}, {alt(P.NOISE_CASED)}))")
simple("meta_filter", tx.is_meta, lambda c: f"(({has_any(f'lower({c})', P.META_WORDS)} OR regexp_matches({c}, {q('(?i)' + P.any_of(P.META))})) AND NOT contains({c}, '<private>'))")
simple("compression_artifact", tx.is_compression_artifact, lambda c: "(" + has_any(f"lower({c})", P.ARTIFACT_WORDS) + "".join(
    f" OR (contains(lower({c}), {q(a)}) AND contains(lower({c}), {q(b)}))" for a, b in P.ARTIFACT_PAIRS) + ")")


def clean_sql(c):
    for tag in P.MESSAGE_TAGS:
        opening, closing = (f"<{tag}", "</>") if tag.startswith(" ") else (f"<{tag}>", f"</{tag}>")
        c = f"regexp_replace(regexp_replace({c}, {q('(?s)' + opening + '.*?' + closing)}, '', 'g'), {q(opening + '[^' + chr(10) + ']*')}, '', 'g')"
    for phrase in P.MESSAGE_PHRASES:
        c = f"replace({c}, {q(phrase)}, '')"
    bad = " OR ".join(f"starts_with({strip_sql('l')}, {q(s)})" for s in P.DROPPED_LINE_STARTS)
    kept = f"list_filter(string_split({c}, chr(10)), lambda l: {strip_sql('l')} <> '' AND NOT ({bad}))"
    return strip_sql(f"array_to_string({kept}, chr(10))")


simple("clean_message", tx.clean_message, clean_sql)


def envelope_sql(c):
    for p in P.ENVELOPE:
        c = f"regexp_replace({c}, {q(p)}, '', 'g')"
    heads = "|".join(h.replace("[", r"\[").replace("]", r"\]").replace("+", r"\+") for h in P.ENVELOPE_HEADERS)
    c = f"regexp_replace(concat({c}, chr(10)), {q(rf'(?m)^[^\S\n]*(?:{heads})[^\n]*\n(?:[^\S\n]*[^\s\[][^\n]*\n)*(?:[^\S\n]*\n)?')}, '', 'g')"
    return f"regexp_replace({c}, '\\s+$', '')"


simple("strip_envelope", tx.strip_envelope, envelope_sql)
simple("quality_score", lambda c: F.round(tx.quality_score(c), 6), lambda c: "round(least(1::DOUBLE, 0.5::DOUBLE" + "".join(
    f" + CASE WHEN strlen({c}) > {b} THEN 0.05::DOUBLE ELSE 0 END" for b in (50, 100, 200)) + "".join(
    f" + CASE WHEN regexp_matches({c}, {q(p)}) THEN {b}::DOUBLE ELSE 0 END" for p, b in P.QUALITY) + "), 6)")
simple("utility_score", tx.utility_score, lambda c: f"""CASE WHEN strlen({strip_sql(c)}) <= 5 THEN 0.2::DOUBLE WHEN strlen({strip_sql(c)}) <= 20 THEN 0.3::DOUBLE
 WHEN regexp_matches({c}, '[0-9]') THEN 0.85::DOUBLE WHEN regexp_matches({strip_sql(c)}, '\\s\\p{{Lu}}') THEN 0.8::DOUBLE WHEN strlen({strip_sql(c)}) > 60 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END""")


def norm_sql(c):
    return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


simple("normalize_dedup", tx.normalize_dedup, norm_sql)
simple("detect_content_kind", tx.content_kind, lambda c: f"""CASE WHEN strlen({c}) > 80000 THEN 'large' WHEN len(regexp_extract_all({c}, {q(P.ROLE_LINE)})) >= 3 THEN 'conversation'
 WHEN len(regexp_extract_all({c}, '\\S+')) < 500 AND NOT regexp_matches({c}, '(?:^|\\n)##? ') THEN 'note' ELSE 'structured' END""")
simple("has_section", lambda c: tx.has_section(c, F.lit("Part two")), lambda c: f"len(list_filter(string_split({c}, chr(10)), lambda l: starts_with(l, '## ') AND ends_with(l, 'Part two'))) > 0")
simple("truncate_sentence", lambda c: tx.truncate_sentence(c, 60), lambda c: f"""CASE WHEN length({c}) <= 60 THEN {c} ELSE concat(CASE WHEN regexp_extract(left({c}, 60), '(?s)^.*[。！？\\n]') <> ''
 THEN regexp_extract(left({c}, 60), '(?s)^.*[。！？\\n]') ELSE left({c}, 60) END, '...') END""")
simple("keyword_intent", lambda c: F.concat_ws("/", *[f.cast("string") for f in tx.keyword_intent(c)]),
       lambda c: f"concat({has_any(f'lower({c})', P.SAVE_WORDS)}::VARCHAR, '/', {has_any(f'lower({c})', P.RECALL_WORDS)}::VARCHAR)")


def request_sql(c):
    asked = f"CASE WHEN regexp_matches({c}, '(?s)<user-request>.*?</user-request>') THEN {strip_sql(f'regexp_extract({c}, {q('(?s)<user-request>(.*?)</user-request>')}, 1)')} ELSE {c} END"
    banner = f"regexp_replace({asked}, '(?s)^\\[(?:search-mode|analyze-mode)\\].*?\\n---\\n?', '')"
    cut = strip_sql(f"regexp_replace({asked}, '^\\[(?:search-mode|analyze-mode)\\]\\s*\\n', '')")
    plain = f"CASE WHEN {banner} <> {asked} AND {strip_sql(banner)} <> '' THEN {strip_sql(banner)} ELSE {cut} END"
    return f"CASE WHEN regexp_matches({plain}, {alt(P.INJECTED_STARTS)}) THEN '' ELSE {plain} END"


simple("user_request", tx.user_request, request_sql)


def sanitize_sql(c):
    clean = f"regexp_replace(regexp_replace({c}, '(?s)<[\\w-]+[^>]*>.*?</[\\w-]+>', '', 'g'), '<[\\w-]+[^>]*/>', '', 'g')"
    clean = strip_sql(fold(clean))
    return f"CASE WHEN length({clean}) <= 300 THEN {clean} ELSE concat(left({clean}, 300), '…[truncated]') END"


simple("sanitize", lambda c: tx.sanitize(c, 300), sanitize_sql)


def denoise_sql(c):
    clean = f"regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '(?s)```.*?```', '', 'g')"
    clean = fold(strip_sql(clean))
    return f"CASE WHEN length({clean}) > 200 THEN concat(left({clean}, 200), '...(truncated)') ELSE {clean} END"


simple("denoise_query", tx.denoise_query, denoise_sql)
simple("recall_signal", tx.recall_signal, lambda c: f"CASE WHEN regexp_matches({c}, {alt(P.RECALL_STRONG)}) THEN 'strong' WHEN regexp_matches({c}, {alt(P.RECALL_MEDIUM)}) THEN 'medium' WHEN regexp_matches({c}, {alt(P.RECALL_WEAK)}) THEN 'weak' ELSE 'none' END")
simple("pref_keywords", lambda c: F.array_join(F.array_sort(tx.preference_keywords(c)), "|"),
       lambda c: f"""array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all({c}, '[a-zA-Z_]{{3,}}'), lambda w: lower(w)),
  list_filter(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)), lambda p: regexp_matches(p, '^[\u4e00-\u9fff]{{2}}$'))))), '|')""", of=("lead",))
simple("recall_query", lambda c: tx.recall_query(tx.denoise_query(c), F.filter(F.array(F.split_part(c, F.lit(" "), F.lit(1)), F.split_part(c, F.lit(" "), F.lit(3))), lambda w: w != "")),
       lambda c: f"""CASE WHEN (split_part({c}, ' ', 1) <> '' OR split_part({c}, ' ', 3) <> '') AND length(array_to_string(list_filter([split_part({c}, ' ', 1), split_part({c}, ' ', 3)], lambda w: w <> ''), ' ')) >= length({denoise_sql(c)}) // 2
  THEN array_to_string(list_filter([split_part({c}, ' ', 1), split_part({c}, ' ', 3)], lambda w: w <> ''), ' ') ELSE {denoise_sql(c)} END""")


def word_set_sql(c):
    return f"list_distinct(list_filter(list_transform(regexp_split_to_array({c}, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> ''))"


@query("word_jaccard", f"""WITH s AS (SELECT fact_id, {word_set_sql('l0_abstract')} AS a, {word_set_sql('l2_content')} AS b FROM facts)
SELECT fact_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) END AS similarity FROM s""")
def word_jaccard(t):
    return t.facts.select("fact_id", F.round(tx.word_jaccard(F.col("l0_abstract"), F.col("l2_content")), 6).alias("similarity"))


def tri_sql(c):
    return f"list_distinct(list_transform(range(1, length({norm_sql(c)}) - 1), lambda i: substr({norm_sql(c)}, i, 3)))"


@query("trigram_jaccard", f"""WITH p AS (SELECT a.fact_id, {tri_sql('a.l0_abstract')} AS x, {tri_sql('b.l0_abstract')} AS y FROM facts a JOIN facts b ON b.batch_id = a.batch_id AND b.fact_index = a.fact_index + 1)
SELECT fact_id, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END, 6) AS similarity FROM p""")
def trigram_jaccard(t):
    nxt = t.facts.select("batch_id", (F.col("fact_index") - 1).alias("fact_index"), F.col("l0_abstract").alias("_next"))
    return t.facts.join(nxt, ["batch_id", "fact_index"]).select(
        "fact_id", F.round(tx.trigram_jaccard(F.col("l0_abstract"), F.col("_next")), 6).alias("similarity"))


@query("split_sections", f"""WITH {CORPUS}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n, len(string_split(text, chr(10))) AS total FROM corpus),
k AS (SELECT * FROM l WHERE NOT (n = total - 1 AND line = '')),
b AS (SELECT *, count(*) FILTER (trim(line, ' ' || chr(9) || chr(13)) <> '') OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
s AS (SELECT *, count(*) FILTER (regexp_matches(line, '^##? ') AND before > 0) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section_no FROM b)
SELECT id, section_no::INT AS section_no, concat(string_agg(line, chr(10) ORDER BY n), chr(10)) AS section FROM s GROUP BY id, section_no""")
def split_sections(t):
    return chunking.sections(corpus(t).select("id", "text"))


@query("split_overflow", f"""WITH {CORPUS}, h AS (SELECT id, text, list_filter(range(1, length(text)), lambda i: substr(text, i, 4) = chr(10) || '## ') AS cuts FROM (SELECT id, lead AS text FROM corpus)),
b AS (SELECT *, list_max(list_filter(cuts, lambda i: length(regexp_replace(left(text, i), '\\s+$', '')) BETWEEN 1 AND 30)) AS best FROM h),
p AS (SELECT *, coalesce(best, len(list_filter(range(1, length(text) + 1), lambda i: strlen(left(text, i - 1)) < 30))) AS place FROM b)
SELECT id, regexp_replace(left(text, place), '\\s+$', '') AS first, regexp_replace(substr(text, place + 1), '^\\s+', '') AS second FROM p""")
def split_overflow(t):
    return corpus(t).select("id", F.inline(F.array(tx.split_overflow(F.col("lead"), 30))))


@query("split_overlap")
def split_overlap(t):
    return chunking.split_overlap(corpus(t).select("id", "text"), 4000, 300)


@query("chunk_blocks", f"""WITH {CORPUS}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n, len(string_split(text, chr(10))) AS total FROM corpus),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) = '' AS blank FROM l WHERE NOT (n = total - 1 AND line = '')),
e AS (SELECT *, blank AND NOT coalesce(lag(blank) OVER (PARTITION BY id ORDER BY n), TRUE) AS ends FROM k),
g AS (SELECT *, count(*) FILTER (ends) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM e),
c AS (SELECT id, regexp_replace(string_agg(line, chr(10) ORDER BY n), '^\\s+|\\s+$', '', 'g') AS content, (min(n) + 1)::INT AS start_line, (max(n) + 1)::INT AS end_line FROM g WHERE NOT ends GROUP BY id, block)
SELECT * FROM c WHERE content <> ''""")
def chunk_blocks(t):
    files = corpus(t).select("id", F.lit("f.py").alias("filename"), F.lit("python").alias("language"), "text")
    return chunking.chunk_blocks(files).select("id", "content", "start_line", "end_line")


@query("paragraph_merge")
def paragraph_merge(t):
    facts = t.facts.select("fact_id", "l2_content", (F.col("fact_id") % 9).alias("_d"))
    old = F.concat(F.lit("## 2024-05-0"), F.col("_d").cast("string"), F.lit(" 10:00 topic\n"), "l2_content")
    new = F.concat(F.lit("## 2024-06-01 11:00 topic\nshort\n## 2024-04-01 other\n"), "l2_content")
    return facts.select("fact_id", chunking.paragraph_merge(old, new).alias("merged"))


@query("relative_age", f"""WITH a AS (SELECT id, ({AS_OF} + (id * 977) % 40000 - created_s) AS s FROM memories),
m AS (SELECT id, s // 60 AS minutes, s // 3600 AS hours, s // 86400 AS days FROM a)
SELECT id, CASE WHEN minutes < 60 THEN minutes || 'm ago' WHEN hours < 24 THEN hours || 'h ago' WHEN days < 30 THEN days || 'd ago' ELSE (days // 30) || 'mo ago' END AS short_age,
 CASE WHEN days < 1 THEN 'today' WHEN days = 1 THEN '1 day ago' WHEN days < 30 THEN days || ' days ago' WHEN days // 30 = 1 THEN '1 month ago' WHEN days // 30 < 12 THEN (days // 30) || ' months ago'
  WHEN days // 360 = 1 THEN '1 year ago' ELSE (days // 360) || ' years ago' END AS worded_age FROM m""")
def relative_age(t):
    stamp = F.timestamp_seconds(F.col("created_s") - (F.col("id") * 977) % 40000)
    return t.memory.select("id", times.short_age(stamp, AS_OF).alias("short_age"), times.worded_age(stamp, AS_OF).alias("worded_age"))


PATHS = r"CASE id % 3 WHEN 0 THEN concat('C:\Work\p', CAST(id AS STRING)) WHEN 1 THEN concat('d:/Data/', CAST(id AS STRING)) ELSE project_path END"


@query("canonical_path", rf"""WITH p AS (SELECT id, {PATHS} AS path FROM memories),
c AS (SELECT id, CASE WHEN regexp_matches(path, '^[a-zA-Z]:[\\/]') THEN concat('/mnt/', lower(left(path, 1)), '/', replace(substr(path, 4), '\', '/')) ELSE path END AS path FROM p)
SELECT id, path, CASE WHEN path IS NOT NULL THEN concat('project_', left(sha256(path), 16)) END AS tag FROM c""")
def canonical_path(t):
    path = (F.when(F.col("id") % 3 == 0, F.concat(F.lit("C:\\Work\\p"), F.col("id").cast("string")))
            .when(F.col("id") % 3 == 1, F.concat(F.lit("d:/Data/"), F.col("id").cast("string"))).otherwise(F.col("project_path")))
    canonical = tx.canonical_path(path)
    return t.memory.select("id", canonical.alias("path"), tx.scope_tag("project_", canonical).alias("tag"))
