from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as tx
from ..operators import reconcile, session_memory
from ..plans import ingest as plan
from ..plans import recall as recall_plan
from .graph import CATEGORIES, RESOLVED, aliases, categories, trigram_rows
from .registry import query
from .search import SIMILAR, TEXT_SCORES, cheap_legs, with_vectors
from .texts import CORPUS, alt, clean_sql, corpus, denoise_sql, norm_sql, q, redact_sql, strip_sql, word_set_sql
from .views import AS_OF


def quality_sql(c):
    return "least(1::DOUBLE, 0.5::DOUBLE" + "".join(f" + CASE WHEN strlen({c}) > {b} THEN 0.05::DOUBLE ELSE 0 END" for b in (50, 100, 200)) + "".join(
        f" + CASE WHEN regexp_matches({c}, {q(p)}) THEN {b}::DOUBLE ELSE 0 END" for p, b in P.QUALITY) + ")"


PREPARED = f"""{RESOLVED}, {CATEGORIES},
prepared AS (SELECT * REPLACE (CASE WHEN llm_confidence = 0 THEN 3 ELSE llm_confidence END AS llm_confidence), {quality_sql('l0_abstract')} AS quality_score FROM resolved
  WHERE (llm_confidence = 0 OR llm_confidence >= 3) AND {strip_sql('l0_abstract')} <> ''
  QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY fact_index) <= 15),
weighted AS (SELECT p.*, coalesce(aw, 0.5)::DOUBLE AS admission_weight, coalesce(ib, 0.5)::DOUBLE AS importance_base,
  least(1, greatest(0.1::DOUBLE, coalesce(ib, 0.5)::DOUBLE * 0.6::DOUBLE + quality_score * 0.4::DOUBLE)) AS importance FROM prepared p LEFT JOIN names ON name = category)"""


def prepared(t):
    ready = reconcile.prepare_facts(t.facts, categories(t), aliases(t))
    rows = reconcile.with_importance(ready, categories(t)).join(t.embeddings.select("vec_id", "embedding"), "vec_id")
    return rows.withColumn("source_text", F.lit(None).cast("string")).withColumn("project_path", F.lit(None).cast("string")).withColumn(
        "agent_id", F.lit("agent-7")).withColumn("tags", F.array().cast("array<string>")).withColumn(
        "visibility", F.lit("global")).withColumn("owner_agent_id", F.lit("")).withColumn("l1_overview", F.lit(None).cast("string"))


@query("prepare_facts", f"WITH {PREPARED} SELECT fact_id, category, llm_confidence, round(quality_score, 6) AS quality_score FROM prepared")
def prepare_facts(t):
    return prepared(t).select("fact_id", "category", "llm_confidence", F.round("quality_score", 6).alias("quality_score"))


@query("fact_importance", f"WITH {PREPARED} SELECT fact_id, round(importance, 6) AS importance FROM weighted")
def fact_importance(t):
    return prepared(t).select("fact_id", F.round("importance", 6).alias("importance"))


TALK = """talk AS (SELECT conv_id AS batch_id, concat(string_agg(concat(role, ': ', content), chr(10) ORDER BY turn), chr(10)) AS conversation FROM session_messages GROUP BY 1)"""
ADMISSION = f"""{PREPARED}, {TALK},
nearest AS (SELECT fact_id, f.tenant_id, e.vec_id, round({SIMILAR}, 6) AS score FROM prepared f JOIN embeddings q ON q.vec_id = f.vec_id JOIN vectors e ON TRUE),
top5 AS (SELECT * FROM (SELECT fact_id, id, score, created_s, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, id) AS rn FROM nearest JOIN memories USING (vec_id, tenant_id)) WHERE rn <= 5 AND score >= 0),
best AS (SELECT fact_id, max(score) AS sim, arg_max(created_s, (score, -id)) AS updated_s FROM top5 GROUP BY 1),
word_sets AS (SELECT fact_id, {word_set_sql('l0_abstract')} AS a, {word_set_sql('conversation')} AS b FROM prepared JOIN talk USING (batch_id)),
overlap AS (SELECT fact_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE END AS confidence FROM word_sets),
parts AS (SELECT w.fact_id, CASE WHEN strlen({strip_sql('l0_abstract')}) <= 5 THEN 0.2::DOUBLE WHEN strlen({strip_sql('l0_abstract')}) <= 20 THEN 0.3::DOUBLE WHEN regexp_matches(l0_abstract, '[0-9]') THEN 0.85::DOUBLE
    WHEN regexp_matches({strip_sql('l0_abstract')}, '\\s\\p{{Lu}}') THEN 0.8::DOUBLE WHEN strlen({strip_sql('l0_abstract')}) > 60 THEN 0.75::DOUBLE ELSE 0.7::DOUBLE END AS utility,
  confidence, 1 - greatest(coalesce(sim, 0), 0) AS novelty, CASE WHEN sim IS NULL THEN 1 ELSE 1 - exp(-greatest(({AS_OF} - updated_s) // 86400, 0) / 30.0::DOUBLE) END AS recency,
  admission_weight AS type_prior, least(llm_confidence / 5.0::DOUBLE, 1) AS semantic_quality FROM weighted w JOIN overlap USING (fact_id) LEFT JOIN best USING (fact_id)),
scored_facts AS (SELECT *, 0.15::DOUBLE * utility + 0.15::DOUBLE * confidence + 0.1::DOUBLE * novelty + 0.1::DOUBLE * recency + 0.3::DOUBLE * type_prior + 0.2::DOUBLE * semantic_quality AS composite FROM parts)"""


def talk(t):
    line = F.concat("role", F.lit(": "), "content", F.lit("\n"))
    return t.session_messages.groupBy(F.col("conv_id").alias("batch_id")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda r: r["l"]), "").alias("conversation"))


def scored(t):
    return reconcile.admission_score(prepared(t).join(talk(t), "batch_id"), t.memory, t.memory_vectors, AS_OF)


PART_NAMES = ["utility", "confidence", "novelty", "recency", "type_prior", "semantic_quality", "composite"]


@query("admission_score", f"WITH {ADMISSION} SELECT fact_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in PART_NAMES) + " FROM scored_facts")
def admission_score(t):
    return scored(t).select("fact_id", *[F.round(c, 6).alias(c) for c in PART_NAMES])


def gate_sql(low, high):
    return f"""CASE WHEN composite < {low} THEN 'reject' WHEN composite >= {high} AND 1 - novelty < 0.55 THEN 'add' WHEN composite >= {high} THEN 'update_or_merge' ELSE 'reject_below_threshold' END"""


@query("admission_gate", f"WITH {ADMISSION} SELECT fact_id, {gate_sql(0.34, 0.52)} AS high_recall, {gate_sql(0.5, 0.65)} AS balanced, {gate_sql(0.58, 0.72)} AS conservative FROM scored_facts")
def admission_gate(t):
    rows = scored(t)
    for preset in ("high_recall", "balanced", "conservative"):
        rows = reconcile.admission_gate(rows, preset).drop("admitted").withColumnRenamed("hint", preset)
    return rows.select("fact_id", "high_recall", "balanced", "conservative")


@query("tag_private", f"""WITH {CORPUS} SELECT id, CASE WHEN p OR id % 50 = 0 THEN 'private' ELSE 'global' END AS visibility, CASE WHEN p OR id % 50 = 0 THEN 'agent-7' ELSE '' END AS owner_agent_id,
 CASE WHEN p OR id % 50 = 0 THEN 1 ELSE 0 END::BIGINT AS n_tags FROM (SELECT id, regexp_matches(text, {alt(P.SENSITIVE)}) AS p FROM corpus)""")
def tag_private(t):
    facts = corpus(t).select("id", F.col("text").alias("l2_content"), F.lit("global").alias("visibility"), F.lit("").alias("owner_agent_id"),
                             F.lit("agent-7").alias("agent_id"), F.when(F.col("id") % 50 == 0, F.array(F.lit("私密"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    return reconcile.tag_private(facts).select("id", "visibility", "owner_agent_id", F.size("tags").cast("bigint").alias("n_tags"))


FACT_GRAMS = TEXT_SCORES.replace("STORE", "tenant_id").replace("FROM memory_queries", "FROM (SELECT fact_id AS query_id, l0_abstract AS query_text FROM prepared)")
GATHER = f"""{PREPARED}, {FACT_GRAMS},
sess AS (SELECT batch_id, memory_id, -1 AS fact, 0 AS leg, memory_id::DOUBLE AS n FROM (SELECT batch_id, m.id AS memory_id, row_number() OVER (PARTITION BY batch_id ORDER BY m.id) AS rn
   FROM (SELECT DISTINCT batch_id, session_id, tenant_id FROM prepared) JOIN memories m USING (session_id, tenant_id)) WHERE rn <= 50),
near AS (SELECT batch_id, m.id AS memory_id, fact_index AS fact, 1 AS leg, -score AS n, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, m.id) AS rn, score
   FROM (SELECT fact_id, batch_id, fact_index, f.tenant_id, e.vec_id, round({SIMILAR}, 6) AS score FROM prepared f JOIN embeddings q ON q.vec_id = f.vec_id JOIN vectors e ON TRUE) JOIN memories m USING (vec_id, tenant_id)),
words AS (SELECT batch_id, memory_id, fact_index AS fact, 2 AS leg, -s AS n FROM (SELECT query_id, b.id AS memory_id, round(max(score), 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 6) DESC, b.id) AS rn
   FROM by_field b JOIN memories m ON m.id = b.id JOIN prepared p ON p.fact_id = query_id AND p.tenant_id = m.tenant_id GROUP BY query_id, b.id) JOIN prepared ON fact_id = query_id WHERE rn <= 20),
firsts AS (SELECT batch_id, memory_id, min((fact, leg, n)) AS place FROM (SELECT * FROM sess UNION ALL SELECT batch_id, memory_id, fact, leg, n FROM near WHERE rn <= 20 AND score >= 0.3 UNION ALL SELECT * FROM words) GROUP BY 1, 2),
gathered AS (SELECT * FROM (SELECT batch_id, memory_id, row_number() OVER (PARTITION BY batch_id ORDER BY place, memory_id) AS place FROM firsts) WHERE place <= 50)"""


def gathered(t):
    return reconcile.gather_existing(prepared(t), t.memory, t.memory_vectors)


@query("gather_existing", f"WITH {GATHER} SELECT batch_id, memory_id, place FROM gathered")
def gather_existing(t):
    return gathered(t).withColumn("place", F.col("place").cast("bigint"))


# Candidates of the dedup check: the memories of the batch's session, in id order, plus planted duplicates.
PLANTED = f"""{PREPARED}, planted AS (SELECT id, m.importance, CASE WHEN id % 4 = 0 THEN f.l0_abstract || '!' WHEN id % 4 = 1 THEN f.l0_abstract || ' and more' ELSE m.l0_abstract END AS l0_abstract,
   CASE WHEN id % 4 = 0 THEN f.l0_abstract ELSE m.content END AS content, f.fact_id AS of_fact FROM memories m LEFT JOIN weighted f ON f.batch_id * 8 + f.fact_index = m.id),
cand AS (SELECT batch_id, id AS memory_id, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS place FROM planted JOIN weighted w ON w.fact_id = of_fact)"""


def planted(t):
    from pyspark.sql import Window
    facts = prepared(t)
    numbered = facts.select("fact_id", "batch_id", F.col("l0_abstract").alias("_f"), (F.col("batch_id") * 8 + F.col("fact_index")).alias("no"))
    joined = t.memory.join(numbered, F.col("no") == F.col("id"), "left")
    kind = F.col("id") % 4
    memories = joined.withColumn("l0_abstract", F.when(kind == 0, F.concat("_f", F.lit("!"))).when(kind == 1, F.concat("_f", F.lit(" and more"))).otherwise(F.col("l0_abstract"))
                                 ).withColumn("content", F.when(kind == 0, F.col("_f")).otherwise(F.col("content")))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))
    candidates = memories.filter("fact_id IS NOT NULL").select("batch_id", F.col("id").alias("memory_id"), place.alias("place"))
    return facts, memories, candidates


DEDUP = f"""{PLANTED},
pairs AS (SELECT f.fact_id, c.memory_id, place, f.importance AS fi, p.importance AS mi, {norm_sql('f.l0_abstract')} AS fn, {norm_sql('p.content')} AS mn, lower(f.l0_abstract) AS a, lower(p.l0_abstract) AS b,
   {norm_sql('f.l0_abstract')} AS x, {norm_sql('p.l0_abstract')} AS y FROM weighted f JOIN cand c USING (batch_id) JOIN planted p ON p.id = c.memory_id),
sets AS (SELECT *, list_distinct(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gx, list_distinct(list_transform(range(1, length(y) - 1), lambda i: substr(y, i, 3))) AS gy FROM pairs),
sims AS (SELECT *, CASE WHEN len(gx) = 0 AND len(gy) = 0 THEN 1 WHEN len(gx) = 0 OR len(gy) = 0 THEN 0 ELSE len(list_intersect(gx, gy)) / (len(gx) + len(gy) - len(list_intersect(gx, gy)))::DOUBLE END AS sim FROM sets),
tiers AS (SELECT *, CASE WHEN fn = mn THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 2 WHEN sim > 0.6 THEN 3 END AS tier FROM sims),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY tier, CASE tier WHEN 1 THEN -place WHEN 2 THEN place ELSE -sim END, place) AS rn FROM tiers WHERE tier IS NOT NULL) WHERE rn = 1)"""


@query("exact_dedup", f"""WITH {DEDUP}
SELECT w.fact_id, tier, memory_id, CASE WHEN tier IS NULL THEN 'new' WHEN mi >= fi THEN 'skip' ELSE 'upgrade' END AS outcome FROM weighted w LEFT JOIN best USING (fact_id)""")
def exact_dedup(t):
    facts, memories, candidates = planted(t)
    return reconcile.exact_dedup(facts, memories, candidates).select("fact_id", "tier", "memory_id", "outcome")


UPGRADED = f"""{DEDUP},
raised AS (SELECT * FROM (SELECT memory_id AS id, w.*, row_number() OVER (PARTITION BY memory_id ORDER BY w.batch_id DESC, w.fact_index DESC, w.fact_id DESC) AS nth
  FROM best JOIN weighted w USING (fact_id) WHERE mi < fi) WHERE nth = 1)"""


def with_texts(facts):
    return facts.withColumn("l1_overview", F.lit(None).cast("string")).withColumn("tags", F.array(F.lit("new")))


@query("upgraded_rows", f"WITH {UPGRADED} SELECT id, l0_abstract AS content, l0_abstract, l2_content, 'new' AS tags, round(least(1, greatest(quality_score, 0.1::DOUBLE)), 6) AS confidence, round(importance, 6) AS importance FROM raised")
def upgraded_rows(t):
    facts, memories, candidates = planted(t)
    rows = reconcile.upgraded_rows(with_texts(facts), reconcile.exact_dedup(facts, memories, candidates), AS_OF)
    return rows.select("id", "content", "l0_abstract", "l2_content", F.array_join("tags", ",").alias("tags"), F.round("confidence", 6).alias("confidence"), F.round("importance", 6).alias("importance"))


@query("session_fast_merge")
def session_fast_merge(t):
    facts, memories, _ = planted(t)
    memories = memories.withColumn("session_id", F.concat(F.lit("sess-"), (F.col("batch_id") % 40).cast("string"))).withColumn(
        "tenant_id", F.concat(F.lit("tenant-"), (F.col("batch_id") % 3).cast("string")))
    return reconcile.session_fast_merge(facts, memories, AS_OF)[0].select("id", "content", "l0_abstract", "importance")


EFFECT = """fx AS (SELECT d.*, f.category, f.l2_content, m.memory_type FROM decisions d JOIN weighted f USING (batch_id, fact_index) LEFT JOIN memories m ON m.id = d.match_id),
eff AS (SELECT *, CASE WHEN upper(action) = 'CONTRADICT' AND category = 'project' THEN 'SUPERSEDE' ELSE upper(action) END AS raw FROM fx),
done AS (SELECT *, CASE WHEN raw IN ('MERGE', 'SUPERSEDE') AND memory_type = 'pinned' THEN 'CREATE' WHEN raw IN ('CREATE', 'SKIP', 'MERGE', 'SUPERSEDE', 'SUPPORT', 'CONTEXTUALIZE', 'CONTRADICT') THEN raw ELSE 'CREATE' END AS effect,
  sha256(concat('fact/', batch_id, '/', fact_index)) AS new_id FROM eff)"""


def applied(t):
    return reconcile.apply_decisions(prepared(t), t.memory, t.decisions)


@query("apply_decisions_inserts", f"WITH {PREPARED}, {EFFECT} SELECT batch_id, fact_index, new_id, effect AS action FROM done WHERE effect IN ('CREATE', 'SUPERSEDE', 'CONTEXTUALIZE', 'CONTRADICT')")
def apply_inserts(t):
    return applied(t).inserts


@query("apply_decisions_updates", f"""WITH {PREPARED}, {EFFECT} SELECT match_id AS id, arg_max(coalesce(merged_content, l2_content), (batch_id, fact_index)) FILTER (effect = 'MERGE') AS content,
 arg_max(new_id, (batch_id, fact_index)) FILTER (effect = 'SUPERSEDE') AS superseded_by, count(*) FILTER (effect = 'SUPPORT') AS supports, count(*) AS changes,
 round(CASE WHEN count(*) FILTER (effect = 'SUPPORT') > 0 THEN least(any_value(confidence) + 0.1::DOUBLE * count(*) FILTER (effect = 'SUPPORT'), 1) ELSE any_value(confidence) END, 6) AS confidence
 FROM done JOIN (SELECT id, confidence FROM memories) ON id = match_id WHERE effect IN ('MERGE', 'SUPERSEDE', 'SUPPORT', 'CONTRADICT') GROUP BY match_id""")
def apply_updates(t):
    return applied(t).updates.withColumn("confidence", F.round("confidence", 6))


@query("apply_decisions_edges", f"""WITH {PREPARED}, {EFFECT} SELECT match_id::VARCHAR AS src_id, 'supports' AS relation_type, match_id::VARCHAR AS target_id FROM done WHERE effect = 'SUPPORT'
 UNION ALL SELECT new_id, 'contextualizes', match_id::VARCHAR FROM done WHERE effect = 'CONTEXTUALIZE' UNION ALL SELECT new_id, 'contradicts', match_id::VARCHAR FROM done WHERE effect = 'CONTRADICT'
 UNION ALL SELECT match_id::VARCHAR, 'contradicts', new_id FROM done WHERE effect = 'CONTRADICT'""")
def apply_edges(t):
    return applied(t).edges.select("src_id", "relation_type", "target_id")


# Upgrades, then what decisions change, on the stored rows; then the new ones.
@query("memory_table", f"""WITH {UPGRADED}, {EFFECT},
upd AS (SELECT match_id AS id, arg_max(coalesce(merged_content, l2_content), (batch_id, fact_index)) FILTER (effect = 'MERGE') AS content,
 arg_max(new_id, (batch_id, fact_index)) FILTER (effect = 'SUPERSEDE') AS superseded_by, count(*) FILTER (effect = 'SUPPORT') AS supports
 FROM done WHERE effect IN ('MERGE', 'SUPERSEDE', 'SUPPORT', 'CONTRADICT') GROUP BY match_id)
SELECT m.id::VARCHAR AS id, coalesce(u.content, r.l0_abstract, m.content) AS content, coalesce(r.l0_abstract, m.l0_abstract) AS l0_abstract,
 round(CASE WHEN u.id IS NOT NULL THEN least(m.confidence + 0.1::DOUBLE * supports, greatest(m.confidence, 1)) WHEN r.id IS NOT NULL THEN least(1, greatest(r.quality_score, 0.1::DOUBLE)) ELSE m.confidence END, 6) AS confidence,
 round(coalesce(r.importance, m.importance), 6) AS importance, coalesce(u.superseded_by, m.superseded_by::VARCHAR) AS superseded_by, version + (CASE WHEN u.id IS NOT NULL OR r.id IS NOT NULL THEN 1 ELSE 0 END) AS version
 FROM memories m LEFT JOIN upd u USING (id) LEFT JOIN raised r ON r.id = m.id
UNION ALL SELECT new_id, w.l0_abstract, w.l0_abstract, round(least(1, greatest(w.quality_score, 0.1::DOUBLE)), 6), round(w.importance, 6), NULL, 1 FROM done JOIN weighted w USING (batch_id, fact_index)
 WHERE effect IN ('CREATE', 'SUPERSEDE', 'CONTEXTUALIZE', 'CONTRADICT')""")
def memory_table(t):
    facts, memories, candidates = planted(t)
    facts = with_texts(facts)
    raised = reconcile.upgraded_rows(facts, reconcile.exact_dedup(facts, memories, candidates), AS_OF)
    done = applied(t)
    whole = facts.withColumn("visibility", F.lit("global")).withColumn("owner_agent_id", F.lit("")).withColumn("project_path", F.lit(None).cast("string"))
    inserts = reconcile.facts_to_memories(whole.join(done.inserts, ["batch_id", "fact_index"], "left_semi"), AS_OF)
    table = plan.memory_table(t.memory, inserts, AS_OF, raised, done.updates)
    return table.select("id", "content", "l0_abstract", F.round("confidence", 6).alias("confidence"), F.round("importance", 6).alias("importance"), "superseded_by", "version")


@query("relation_table", f"""WITH {PREPARED}, {EFFECT} SELECT src_id::VARCHAR AS src_id, relation_type, target_id::VARCHAR AS target_id FROM memory_relations
 UNION SELECT match_id::VARCHAR, 'supports', match_id::VARCHAR FROM done WHERE effect = 'SUPPORT'
 UNION SELECT new_id, 'contextualizes', match_id::VARCHAR FROM done WHERE effect = 'CONTEXTUALIZE' UNION SELECT new_id, 'contradicts', match_id::VARCHAR FROM done WHERE effect = 'CONTRADICT'
 UNION SELECT match_id::VARCHAR, 'contradicts', new_id FROM done WHERE effect = 'CONTRADICT'""")
def relation_table(t):
    return plan.relation_table(t.memory_relations, applied(t).edges)


@query("category_action_rules", """WITH r(name, always_merge, append_only) AS (VALUES ('identity', TRUE, FALSE), ('emotional', FALSE, TRUE), ('work', FALSE, TRUE), ('decisions', FALSE, TRUE)),
d AS (SELECT id, category, CASE id % 7 WHEN 0 THEN 'CREATE' WHEN 1 THEN 'MERGE' WHEN 2 THEN 'SKIP' WHEN 3 THEN 'SUPERSEDE' WHEN 4 THEN 'SUPPORT' WHEN 5 THEN 'contradict' ELSE 'CONTEXTUALIZE' END AS action FROM memories)
SELECT id, action, CASE WHEN append_only THEN upper(action) NOT IN ('CREATE', 'SKIP', 'MERGE') WHEN always_merge THEN upper(action) IN ('SUPERSEDE', 'CONTRADICT') ELSE FALSE END AS violates FROM d LEFT JOIN r ON name = category""")
def category_action_rules(t):
    names = ["CREATE", "MERGE", "SKIP", "SUPERSEDE", "SUPPORT", "contradict", "CONTEXTUALIZE"]
    action = F.array(*[F.lit(n) for n in names])[(F.col("id") % 7).cast("int")]
    rows = t.memory.select("id", "tenant_id", "category", action.alias("action"))
    return reconcile.category_action_rules(rows, categories(t)).select("id", "action", "violates")


@query("batch_keep", """WITH k AS (SELECT batch_id, fact_index FROM facts WHERE llm_confidence = 3) SELECT fact_id FROM facts f WHERE EXISTS (SELECT 1 FROM k WHERE k.batch_id = f.batch_id AND k.fact_index = f.fact_index)
 OR NOT EXISTS (SELECT 1 FROM k WHERE k.batch_id = f.batch_id)""")
def batch_keep(t):
    return reconcile.batch_keep(t.facts, t.facts.filter("llm_confidence = 3")).select("fact_id")


@query("facts_to_memories", f"WITH {PREPARED} SELECT sha256(concat('fact/', batch_id, '/', fact_index)) AS id, l0_abstract AS content, 'insight' AS memory_type, round(least(1, greatest(quality_score, 0.1::DOUBLE)), 6) AS confidence, 'ingest' AS source, {AS_OF}::BIGINT AS created_s FROM weighted")
def facts_to_memories(t):
    return reconcile.facts_to_memories(prepared(t), AS_OF).select(
        "id", "content", "memory_type", F.round("confidence", 6).alias("confidence"), "source", F.unix_seconds("created_at").alias("created_s"))


def topics(t):
    """Every conversation turn is a topic of its session."""
    kind = F.col("turn") % 3
    return t.session_messages.join(t.facts.select(F.col("batch_id").alias("conv_id"), F.col("fact_index").alias("turn"), "tenant_id", "l0_abstract"), ["conv_id", "turn"]).select(
        "session_id", (F.col("conv_id") * 100 + F.col("turn")).alias("topic_no"), "tenant_id",
        F.concat(F.lit("topic "), (F.col("turn") % 4).cast("string")).alias("topic"), F.col("content").alias("summary"),
        F.when(kind == 0, F.col("l0_abstract")).alias("overview"), F.when(kind == 1, F.lit("detail")).alias("detail"),
        F.when(kind == 0, "WORK").when(kind == 1, "pinned").alias("memory_type"), F.when(kind == 2, "Likes").alias("category"),
        F.when(F.col("conv_id") % 5 == 0, "private").otherwise("global").alias("scope"),
        F.array(F.lit("a"), F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c")).alias("tags"), F.lit("session_ingest").alias("ingest_source"), F.lit("/srv/app").alias("project_path"))


@query("topics_to_memories", """WITH x AS (SELECT s.session_id, s.conv_id * 100 + s.turn AS topic_no, s.turn, s.conv_id, f.l0_abstract, CASE WHEN length(content) > 800 THEN left(content, 797) || '...' ELSE content END AS summary
  FROM session_messages s JOIN facts f ON f.batch_id = s.conv_id AND f.fact_index = s.turn)
SELECT sha256(concat('topic/', session_id, '/', topic_no)) AS id, summary AS content, CASE WHEN turn % 3 = 0 AND l0_abstract <> '' THEN l0_abstract WHEN length(summary) > 150 THEN left(summary, 147) || '...' ELSE summary END AS l1_overview,
 CASE WHEN turn % 3 = 1 THEN 'detail' WHEN length(summary) > 500 THEN left(summary, 497) || '...' ELSE summary END AS l2_content, CASE WHEN turn % 3 = 0 THEN 'WORK' WHEN conv_id % 5 = 0 THEN 'EMOTIONAL' ELSE 'WORK' END AS kind,
 CASE WHEN turn % 3 = 2 THEN 'likes' WHEN conv_id % 5 = 0 THEN 'profile' ELSE 'events' END AS category, 'a,b,a,session_ingest' AS tags, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE '/srv/app' END AS project_path FROM x""")
def topics_to_memories(t):
    return session_memory.topics_to_memories(topics(t), AS_OF).select(
        "id", "content", "l1_overview", "l2_content", "kind", "category", F.array_join("tags", ",").alias("tags"), "project_path")


def open_memories(t):
    return t.memory.filter("source = 'session_ingest'").select(
        "id", "session_id", F.when(F.col("scope") == "private", "EMOTIONAL").otherwise("WORK").alias("kind"), "content", "l0_abstract",
        F.col("l0_abstract").alias("l1_overview"), F.col("l0_abstract").alias("l2_content"), "tags", "created_at")


@query("append_topics")
def append_topics(t):
    return session_memory.append_topics(open_memories(t), topics(t), AS_OF)


@query("conversation_tail", f"""WITH m AS (SELECT conv_id, turn, role, {clean_sql('content')} AS txt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM session_messages) WHERE rn <= 6),
j AS (SELECT conv_id, concat(string_agg(concat('[', role, ']: ', txt), chr(10) || chr(10) ORDER BY turn), chr(10) || chr(10)) AS t FROM m WHERE role IN ('user', 'assistant') AND txt <> '' GROUP BY 1),
c AS (SELECT conv_id, t, right(t, 900) AS tail FROM j)
SELECT conv_id, CASE WHEN strlen(t) <= 900 THEN t WHEN instr(tail, chr(10) || '[') > 0 THEN substr(tail, instr(tail, chr(10) || '[') + 1) ELSE tail END AS conversation FROM c""")
def conversation_tail(t):
    return session_memory.conversation_tail(t.session_messages, 6, 900)


@query("extract_window", """WITH j AS (SELECT conv_id, concat(string_agg(concat(role, ': ', content), chr(10) ORDER BY turn), chr(10)) AS t FROM session_messages GROUP BY 1),
k AS (SELECT conv_id, t, len(list_filter(range(1, length(t) + 1), lambda i: strlen(substr(t, i)) <= 900)) AS n FROM j), c AS (SELECT conv_id, t, right(t, n) AS tail FROM k)
SELECT conv_id, CASE WHEN strlen(t) <= 900 THEN t WHEN instr(tail, chr(10)) BETWEEN 1 AND length(tail) - 1 THEN substr(tail, instr(tail, chr(10)) + 1) ELSE tail END AS window FROM c""")
def extract_window(t):
    return session_memory.extract_window(t.session_messages, 900)


@query("cross_session_tail", f"""WITH RECURSIVE s AS (SELECT query_id * 10 + k AS query_id, concat('tenant-', k) AS tenant_id, mq.project_path, e.vec_id, round({SIMILAR}, 6) AS score FROM memory_queries mq CROSS JOIN unnest([0, 1, 2]) u(k) JOIN embeddings q ON q.vec_id = mq.query_vec_id JOIN vectors e ON TRUE),
r AS (SELECT query_id, m.id, m.scope, m.source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.id) AS rn FROM s JOIN memories m USING (vec_id, tenant_id)
   WHERE s.project_path IS NULL OR m.project_path IS NULL OR m.visibility = 'private' OR m.project_path = s.project_path OR starts_with(m.project_path, s.project_path || '/') OR starts_with(s.project_path, m.project_path || '/')),
b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM r WHERE rn <= 20 AND score >= 0.5 AND scope <> 'private' AND source = 'session_ingest'),
nxt AS (SELECT src_id, min(target_id) AS target_id FROM memory_relations WHERE relation_type = 'continued_by' GROUP BY 1),
walk AS (SELECT id, id AS place FROM memories UNION ALL SELECT walk.id, target_id FROM walk JOIN nxt ON src_id = place), tails AS (SELECT id, max(place) AS tail_id FROM walk GROUP BY id)
SELECT query_id, id AS hit_id, score, tail_id FROM b JOIN tails USING (id) WHERE n = 1""")
def cross_session_tail(t):
    each = with_vectors(t).select("query_id", "embedding", "project_path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    asked = each.select((F.col("query_id") * 10 + F.col("k")).alias("query_id"), F.concat(F.lit("tenant-"), "k").alias("tenant_id"), "embedding", "project_path")
    return session_memory.cross_session_tail(asked, t.memory, t.memory_vectors, t.memory_relations, 0.1)


@query("usable_messages", f"""WITH n AS (SELECT conv_id, turn, content, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, sum(strlen(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM session_messages)
SELECT conv_id, turn, {redact_sql('content')} AS content FROM n WHERE rn <= 20 AND (used <= 200000 OR rn = 1) AND {strip_sql(f"replace({redact_sql('content')}, '[REDACTED]', '')")} <> ''
 AND NOT (regexp_matches(content, {q('(?i)' + P.any_of(P.META))}) AND NOT contains(content, '<private>'))""")
def usable_messages(t):
    return plan.usable_messages(t.session_messages).select("conv_id", "turn", "content")


def ingested(t):
    firsts = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    prototypes = t.embeddings.join(firsts, ["label", "vec_id"]).select("embedding")
    raw = t.facts.join(t.embeddings.select("vec_id", "embedding"), "vec_id").withColumn("source_text", F.lit(None).cast("string")).withColumn(
        "project_path", F.lit(None).cast("string")).withColumn("agent_id", F.lit("agent-7")).withColumn("tags", F.array().cast("array<string>")).withColumn(
        "visibility", F.lit("global")).withColumn("owner_agent_id", F.lit("")).withColumn("l1_overview", F.lit(None).cast("string"))
    from ..operators.graph import with_hash
    stored = with_hash(t.session_messages.filter("role = 'system'"))
    return plan.ingest(t.session_messages, stored, raw, t.decisions, t.memory, t.memory_vectors, categories(t), aliases(t), prototypes, AS_OF)


@query("ingest")
def ingest(t):
    return ingested(t).inserts.select("id", "content", "category", "importance", "confidence", "visibility", "session_id")


FILES = f"""files AS (SELECT id AS file_no, concat('task-', CAST(id % 4 AS STRING)) AS task_id, text, sha256(text) AS content_hash, CASE WHEN id % 11 = 0 THEN 'note' ELSE 'auto' END AS strategy FROM corpus),
known AS (SELECT content_hash FROM files WHERE file_no < 1000000 AND file_no % 6 = 0)"""


def import_input(t):
    files = corpus(t).select(F.col("id").alias("file_no"), F.concat(F.lit("task-"), (F.col("id") % 4).cast("string")).alias("task_id"), "text",
                             F.when(F.col("id") % 11 == 0, "note").otherwise("auto").alias("strategy"))
    stored = files.filter("file_no < 1000000 AND file_no % 6 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return plan.import_batch(files, stored)


@query("import_batch", f"WITH {CORPUS}, {FILES} SELECT task_id, count(*) AS files, count(*) FILTER (content_hash IN (SELECT content_hash FROM known)) AS rejected FROM files GROUP BY 1")
def import_batch(t):
    return import_input(t)[1].select("task_id", "files", "rejected")


@query("import_batch_parts")
def import_parts(t):
    return import_input(t)[0].select("task_id", "file_no", "kind", "part_no", "content")


@query("rollback_import", "SELECT id FROM memories WHERE NOT coalesce(session_id = 'import-7' OR (source = 'ingest' AND created_s >= 1709251200), FALSE)")
def rollback_import(t):
    return plan.rollback_import(t.memory, "7", 1709251200, "ingest").select("id")


def gate_value(which, yes="query_id % 3 = 0"):
    levels = P.RECALL_LEVELS
    return f"CASE WHEN {yes} OR sig = 'strong' THEN {levels['strong'][which]}::DOUBLE WHEN sig = 'medium' THEN {levels['medium'][which]}::DOUBLE WHEN sig = 'weak' THEN {levels['weak'][which]}::DOUBLE ELSE {levels['none'][which]}::DOUBLE END"


@query("recall_thresholds", f"""WITH {CORPUS}, s AS (SELECT id AS query_id, {denoise_sql('text')} AS d FROM corpus),
g AS (SELECT query_id, CASE WHEN regexp_matches(d, {alt(P.RECALL_STRONG)}) THEN 'strong' WHEN regexp_matches(d, {alt(P.RECALL_MEDIUM)}) THEN 'medium' WHEN regexp_matches(d, {alt(P.RECALL_WEAK)}) THEN 'weak' ELSE 'none' END AS sig FROM s)
SELECT query_id, sig AS signal, {gate_value(0)} AS min_score, {gate_value(1)} AS gate FROM g""")
def recall_thresholds(t):
    queries = corpus(t).select(F.col("id").alias("query_id"), F.col("text").alias("query_text"), (F.col("id") % 3 == 0).alias("gate_yes"))
    return recall_plan.recall_thresholds(queries).select("query_id", "signal", "min_score", "gate")


@query("recall")
def recall(t):
    queries = with_vectors(t).withColumn("project_tags", F.col("tags")).withColumn(
        "keywords", F.lit(None).cast("array<string>")).withColumn("gate_yes", F.col("query_id") % 3 == 0)
    return recall_plan.recall(queries, t.memory, t.memory_vectors, t.memory_relations, AS_OF).verdicts.select(
        "query_id", "n", "confidence", "max_score", "gate", "reason", "should_recall")


@query("context_blocks")
def context_blocks(t):
    from ..operators import profile
    from ..plans.context import context_blocks as blocks
    requests = t.memory_queries.select(F.concat(F.lit("q-"), F.col("query_id").cast("string")).alias("session_id"), "tenant_id", F.col("project_path").alias("project"))
    profiles = profile.profile_text(t.preferences, requests.select("tenant_id", "project").distinct())
    hits = cheap_legs(t)[0].filter("rank <= 5").select(F.concat(F.lit("q-"), F.col("query_id").cast("string")).alias("session_id"), "memory_id", "score")
    return blocks(requests, t.memory, profiles, hits, AS_OF)
