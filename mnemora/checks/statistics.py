from pyspark.sql import functions as F

from ..operators import stats
from .registry import query
from .views import AS_OF


@query("memory_stats", """WITH k AS (SELECT *, CASE WHEN space_id = '' THEN 'default' ELSE space_id END AS sk FROM memories),
u AS (SELECT 'type' AS dimension, memory_type AS key FROM k UNION ALL SELECT 'category', category FROM k UNION ALL SELECT 'tier', tier FROM k
 UNION ALL SELECT 'state', state FROM k UNION ALL SELECT 'space', sk FROM k UNION ALL SELECT 'visibility', visibility FROM k
 UNION ALL SELECT 'agent', owner_agent_id FROM k UNION ALL SELECT 'source', coalesce(source, 'store') FROM k)
SELECT dimension, key, count(*)::DOUBLE AS value FROM u GROUP BY 1, 2
UNION ALL SELECT 'total', '', count(*) FROM k UNION ALL SELECT 'avg_importance', '', round(avg(importance), 6) FROM k
UNION ALL SELECT 'avg_confidence', '', round(avg(confidence), 6) FROM k UNION ALL SELECT 'total_access', '', sum(access_count)::DOUBLE FROM k""")
def memory_stats(t):
    return stats.memory_stats(t.memory).withColumn("value", F.round("value", 6))


@query("timeline", f"""SELECT strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d') AS day, memory_type, count(*) AS n FROM memories
 WHERE created_s >= {AS_OF - 60 * 86400} GROUP BY 1, 2""")
def timeline(t):
    return stats.timeline(t.memory, AS_OF, 60).withColumn("day", F.col("day").cast("string"))


USAGE = """u AS (SELECT tag, count(*) AS usages, count(DISTINCT CASE WHEN space_id = '' THEN 'default' ELSE space_id END) AS spaces FROM memory_tags JOIN memories USING (id) GROUP BY tag)"""


@query("tag_stats_all", f"WITH {USAGE} SELECT tag, usages, spaces FROM u")
def tag_stats_all(t):
    return stats.tag_stats(t.memory, None)


@query("tag_stats", f"WITH {USAGE} SELECT tag, usages, spaces FROM u WHERE usages >= 40 ORDER BY usages DESC, tag LIMIT 10")
def tag_stats(t):
    return stats.tag_stats(t.memory, 10, 40)


@query("cross_space_tags", f"WITH {USAGE} SELECT tag, usages, spaces FROM u WHERE spaces >= 2")
def cross_space_tags(t):
    return stats.cross_space_tags(t.memory)


@query("tag_totals", f"WITH {USAGE} SELECT count(*) FILTER (usages >= 40) AS unique_tags, sum(usages)::BIGINT AS usages FROM u")
def tag_totals(t):
    return stats.tag_totals(t.memory, 40)


TOP = """c AS (SELECT {by}, category, count(*) AS n FROM memories GROUP BY 1, 2),
top AS (SELECT {by}, string_agg(category || ':' || n, '|' ORDER BY n DESC, category) AS top_categories FROM
  (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, category) AS rn FROM c) WHERE rn <= 3 GROUP BY {by})"""


@query("space_stats", f"""WITH {TOP.format(by='space_id')},
m AS (SELECT space_id, count(*) AS memories, count(DISTINCT owner_agent_id) AS agents, count(*) FILTER (tier = 'core') AS core, count(*) FILTER (tier = 'working') AS working,
  count(*) FILTER (tier = 'peripheral') AS peripheral, max(created_s) AS last_s, count(shared_from_memory) AS shared_in FROM memories GROUP BY space_id),
p AS (SELECT space_id, count(*) AS members FROM space_members GROUP BY space_id)
SELECT s.space_id, s.space_type, s.owner_id, coalesce(m.memories, 0) AS memories, coalesce(agents, 0) AS agents, coalesce(core, 0) AS core, coalesce(working, 0) AS working,
 coalesce(peripheral, 0) AS peripheral, last_s, coalesce(shared_in, 0) AS shared_in, coalesce(top_categories, '') AS top_categories, coalesce(members, 0) AS members
FROM spaces s LEFT JOIN m USING (space_id) LEFT JOIN top USING (space_id) LEFT JOIN p USING (space_id)""")
def space_stats(t):
    return stats.space_stats(t.spaces, t.memory, t.space_members).withColumn(
        "last_s", F.unix_seconds("last_activity")).drop("last_activity")


RECENT = "ts >= TIMESTAMP '2024-01-20' - INTERVAL 15 DAYS"
SINCE, WINDOW_DAYS = "2024-01-20 00:00:00", 15


@query("sharing_summary", f"""SELECT count(*) FILTER (action IN ('share', 'batch_share', 'reshare')) AS total_shares, count(*) FILTER (action = 'pull') AS total_pulls,
 count(*) FILTER (action = 'unshare') AS total_unshares, count(DISTINCT user_id) FILTER (action IN ('share', 'batch_share', 'reshare')) AS unique_sharers FROM sharing_events WHERE {RECENT}""")
def sharing_summary(t):
    return stats.sharing_summary(t.sharing_events, SINCE, WINDOW_DAYS)


@query("sharing_edges", f"SELECT from_space, to_space, count(*) AS n FROM sharing_events WHERE {RECENT} AND action IN ('share', 'batch_share', 'reshare') GROUP BY 1, 2")
def sharing_edges(t):
    return stats.sharing_edges(t.sharing_events, SINCE, WINDOW_DAYS)


@query("sharing_days", f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (action IN ('share', 'batch_share')) AS shares, count(*) FILTER (action = 'pull') AS pulls FROM sharing_events WHERE {RECENT} GROUP BY 1")
def sharing_days(t):
    return stats.sharing_days(t.sharing_events, SINCE, WINDOW_DAYS).withColumn("day", F.col("day").cast("string"))


@query("agent_stats", f"""WITH {TOP.format(by='owner_agent_id')},
f AS (SELECT owner_agent_id, count(*) AS memories, max(created_s) AS last_s FROM memories GROUP BY 1),
h AS (SELECT agent_id AS owner_agent_id, count(*) AS shares FROM sharing_events WHERE action IN ('share', 'batch_share') GROUP BY 1)
SELECT owner_agent_id, memories, last_s, top_categories, coalesce(shares, 0) AS shares FROM f JOIN top USING (owner_agent_id) LEFT JOIN h USING (owner_agent_id)""")
def agent_stats(t):
    return stats.agent_stats(t.memory, t.sharing_events).withColumn("last_s", F.unix_seconds("last_active")).drop("last_active")


@query("agent_spaces", "SELECT owner_agent_id, CASE WHEN space_id = '' THEN 'default' ELSE space_id END AS space, count(*) AS n FROM memories GROUP BY 1, 2")
def agent_spaces(t):
    return stats.agent_spaces(t.memory)


@query("session_groups", """SELECT session_id, count(*) AS recalls, count(*) FILTER (recall_type = 'auto') AS auto, count(*) FILTER (recall_type = 'manual') AS manual,
 max(ts) AS last_ts, arg_max(query_text, (ts, event_id)) AS latest_query FROM recall_events GROUP BY session_id""")
def session_groups(t):
    return stats.session_groups(t.recall_events)


@query("profile_stats", """SELECT tenant_id, 'scope' AS dimension, scope AS key, count(*) AS n FROM preferences GROUP BY 1, 3
 UNION ALL SELECT tenant_id, 'status', status, count(*) FROM preferences GROUP BY 1, 3""")
def profile_stats(t):
    return stats.profile_stats(t.preferences)


@query("last_runs", """SELECT user_id AS tenant_id, max(ts) AS last_run, arg_max(CASE action WHEN 'share' THEN 'completed' WHEN 'pull' THEN 'failed' ELSE 'skipped' END, (ts, id)) AS last_status
FROM sharing_events GROUP BY user_id""")
def last_runs(t):
    return stats.last_runs(induction_runs(t)).select("tenant_id", F.col("last_run").cast("timestamp_ntz").alias("last_run"), "last_status")


def induction_runs(t):
    """Sharing events stand in for induction runs of the acting user."""
    return t.sharing_events.select(
        F.col("id").alias("run_id"), F.col("user_id").alias("tenant_id"), F.col("ts").cast("timestamp").alias("started_at"),
        F.when(F.col("action") == "share", "completed").when(F.col("action") == "pull", "failed").otherwise("skipped").alias("status"))


@query("recall_verdict", """WITH q AS (SELECT event_id AS query_id, CASE event_id % 3 WHEN 0 THEN 0.35::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.48::DOUBLE END AS gate FROM recall_events),
s AS (SELECT event_id AS query_id, count(*) AS n, avg(score) AS confidence, max(score) AS max_score FROM recall_items WHERE is_kept GROUP BY 1),
j AS (SELECT q.query_id, gate, coalesce(n, 0) AS n, coalesce(confidence, 0) AS confidence, coalesce(max_score, 0) AS max_score FROM q LEFT JOIN s USING (query_id))
SELECT query_id, gate, n, round(confidence, 6) AS confidence, max_score, CASE WHEN n = 0 THEN 'no_relevant_memories' WHEN max_score <= gate THEN 'below_quality_gate' ELSE 'ok' END AS reason,
 n > 0 AND max_score > gate AS should_recall FROM j""")
def recall_verdict(t):
    kind = F.col("event_id") % 3
    queries = t.recall_events.select(F.col("event_id").alias("query_id"),
                                     F.when(kind == 0, 0.35).when(kind == 1, 0.4).otherwise(0.48).alias("gate"))
    results = t.recall_items.filter("is_kept").withColumnRenamed("event_id", "query_id")
    return stats.recall_verdict(queries, results).withColumn("confidence", F.round("confidence", 6))


@query("retrieval_trace", """WITH u AS (SELECT memory_id % 50 AS query_id, 0 AS stage_no, 'fused' AS stage, score FROM recall_items
 UNION ALL SELECT memory_id % 50, 1, 'min_score', score FROM recall_items WHERE score >= 0.15 UNION ALL SELECT memory_id % 50, 2, 'kept', score FROM recall_items WHERE score >= 0.15 AND is_kept),
c AS (SELECT query_id, stage_no, stage, count(*) AS rows_out, min(score) AS min_score, max(score) AS max_score FROM u GROUP BY 1, 2, 3)
SELECT *, coalesce(lag(rows_out) OVER w, 0) AS rows_in, greatest(coalesce(lag(rows_out) OVER w, 0) - rows_out, 0) AS dropped FROM c WINDOW w AS (PARTITION BY query_id ORDER BY stage_no)""")
def retrieval_trace(t):
    fused = t.recall_items.select((F.col("memory_id") % 50).alias("query_id"), F.col("item_id").alias("memory_id"), "score", "is_kept")
    cut = fused.filter("score >= 0.15")
    return stats.retrieval_trace([("fused", fused), ("min_score", cut), ("kept", cut.filter("is_kept"))])


ENTRIES = """entries AS (SELECT doc_id AS id, concat('n', CAST(doc_id % 200 AS STRING)) AS name, lang, text AS body, split_part(text, '.', 1) AS description,
 CASE doc_id % 4 WHEN 0 THEN 'merged' WHEN 1 THEN 'updated' ELSE 'added' END AS source FROM documents)"""
ARCHIVE = "archive AS (SELECT DISTINCT concat('n', CAST(doc_id % 150 AS STRING)) AS name FROM labels)"


def entries(t):
    kind = F.col("doc_id") % 4
    return t.documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("n"), (F.col("doc_id") % 200).cast("string")).alias("name"), "lang",
        F.col("text").alias("body"), F.split_part("text", F.lit("."), F.lit(1)).alias("description"),
        F.when(kind == 0, "merged").when(kind == 1, "updated").otherwise("added").alias("source"))


def archive(t):
    return t.labels.select(F.concat(F.lit("n"), (F.col("doc_id") % 150).cast("string")).alias("name"))


@query("demote_kept", f"""WITH {ENTRIES}, {ARCHIVE}, j AS (SELECT *, source = 'added' AND name IN (SELECT name FROM archive) AS hit FROM entries)
SELECT id, CASE WHEN hit THEN 'kept' ELSE source END AS source, CASE WHEN hit THEN '' ELSE body END AS body, CASE WHEN hit THEN '' ELSE description END AS description FROM j""")
def demote_kept(t):
    return stats.demote_kept(entries(t), archive(t)).select("id", "source", "body", "description")


@query("consolidation_stats", f"""WITH {ENTRIES}, {ARCHIVE}, j AS (SELECT lang, CASE WHEN source = 'added' AND name IN (SELECT name FROM archive) THEN 'kept' ELSE source END AS source FROM entries)
SELECT lang, count(*) FILTER (source = 'merged') AS merged, count(*) FILTER (source = 'updated') AS updated, count(*) FILTER (source = 'added') AS added, count(*) FILTER (source = 'kept') AS kept, count(*) AS total FROM j GROUP BY lang""")
def consolidation_stats(t):
    return stats.consolidation_stats(entries(t), archive(t), "lang")


@query("archive_names", """WITH l AS (SELECT conv_id AS id, unnest(string_split(concat('---', chr(10), '  name: "conv ', conv_id, '"', chr(10), content), chr(10))) AS line, turn FROM session_messages)
SELECT id, trim(trim(substr(trim(line), 6)), '"') AS name FROM l WHERE starts_with(trim(line), 'name:')""")
def archive_names(t):
    text = F.concat(F.lit('---\n  name: "conv '), F.col("conv_id").cast("string"), F.lit('"\n'), "content")
    return stats.archive_names(t.session_messages.select(F.col("conv_id").alias("id"), text.alias("text")))


EXPECT = """r AS (SELECT event_id % 100 AS query_id, item_id AS memory_id, score, content FROM recall_items JOIN memories ON id = memory_id),
x AS (SELECT DISTINCT event_id % 110 AS query_id FROM events),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM r) WHERE rn <= 5),
s AS (SELECT query_id, count(*) AS results, lower(string_agg(content, ' ' ORDER BY score DESC, memory_id)) AS txt FROM b GROUP BY 1),
e AS (SELECT query_id, coalesce(results, 0) AS results, coalesce(results, 0) > 0 AND contains(coalesce(txt, ''), 'qu') AND NOT contains(coalesce(txt, ''), 'password') AS passed FROM x LEFT JOIN s USING (query_id))"""


def evaluated(t):
    results = t.recall_items.select(
        (F.col("event_id") % 100).alias("query_id"), F.col("item_id").alias("memory_id"), "score", F.col("memory_id").alias("text_id"))
    wanted = t.events.select((F.col("event_id") % 110).alias("query_id")).distinct().select(
        "query_id", F.lit("QU").alias("should_contain"), F.lit("Password").alias("should_not_contain"))
    return stats.retrieval_eval(results, t.memory.select(F.col("id").alias("text_id"), "content"), wanted)


@query("retrieval_eval", f"WITH {EXPECT} SELECT * FROM e")
def retrieval_eval(t):
    return evaluated(t).select("query_id", "results", "passed")


@query("eval_score", f"WITH {EXPECT} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, round(avg(CASE WHEN passed THEN 1.0::DOUBLE ELSE 0 END) * 100, 6) AS score FROM e")
def eval_score(t):
    return stats.eval_score(evaluated(t)).withColumn("score", F.round("score", 6))


@query("chain_inherit", """WITH c AS (SELECT DISTINCT src_id AS root_id, target_id AS id FROM memory_relations WHERE relation_type IN ('continues', 'continued_by') UNION SELECT id, id FROM memories),
r AS (SELECT root_id, m.*, CASE tier WHEN 'core' THEN 2 WHEN 'working' THEN 1 ELSE 0 END AS rk FROM c JOIN memories m USING (id)),
g AS (SELECT root_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM c JOIN memory_tags USING (id) GROUP BY 1)
SELECT root_id, arg_max(tier, rk) AS tier, max(importance) AS importance, any_value(tags) AS tags FROM r LEFT JOIN g USING (root_id) GROUP BY root_id""")
def chain_inherit(t):
    links = t.memory_relations.filter("relation_type IN ('continues', 'continued_by')").select(
        F.col("src_id").alias("root_id"), F.col("target_id").alias("id"))
    chains = links.unionByName(t.memory.select(F.col("id").alias("root_id"), "id")).distinct()
    return stats.chain_inherit(chains, t.memory)


@query("spaces_union", """WITH a AS (SELECT owner_id AS user_id, space_id, space_type FROM spaces UNION SELECT user_id, m.space_id, s.space_type FROM space_members m JOIN spaces s ON s.space_id = m.space_id)
SELECT user_id, id, space_id FROM (SELECT user_id, m.id, m.space_id, row_number() OVER (PARTITION BY user_id, m.id ORDER BY CASE WHEN space_type = 'personal' THEN 0 ELSE 1 END, m.space_id) AS rn FROM memories m JOIN a ON a.space_id = m.space_id) WHERE rn = 1""")
def spaces_union(t):
    from ..operators import graph
    return stats.spaces_union(t.memory, graph.accessible_spaces(t.spaces, t.space_members)).select("user_id", "id", "space_id")
