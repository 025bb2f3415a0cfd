from pyspark.sql import functions as F

from ..operators import profile as ops
from .lifecycle import typed_preferences
from .registry import query
from .statistics import induction_runs
from .views import AS_OF

ITEMS = """items AS (SELECT conv_id * 100 + turn AS item_id, concat('tenant-', CAST(conv_id % 3 AS STRING)) AS tenant_id, CASE turn % 5 WHEN 0 THEN 'tone' WHEN 1 THEN 'custom:editor' WHEN 2 THEN 'custom:Bad' WHEN 3 THEN 'language' ELSE 'code_style' END AS slot,
 split_part(text, '.', 1) AS value, CAST(turn * 20 AS DOUBLE) / 100 AS confidence, CASE WHEN turn % 4 = 3 THEN 'session' ELSE 'global' END AS scope FROM conversations
 UNION ALL SELECT 1000000 + id, tenant_id, slot, CASE WHEN id % 2 = 0 THEN value ELSE concat(value, ' xtra') END, 0.5, 'global' FROM preferences)"""


def items(t):
    turn = F.col("turn")
    said = t.conversations.select(
        (F.col("conv_id") * 100 + turn).alias("item_id"), F.concat(F.lit("tenant-"), (F.col("conv_id") % 3).cast("string")).alias("tenant_id"),
        F.when(turn % 5 == 0, "tone").when(turn % 5 == 1, "custom:editor").when(turn % 5 == 2, "custom:Bad").when(turn % 5 == 3, "language").otherwise("code_style").alias("slot"),
        F.split_part("text", F.lit("."), F.lit(1)).alias("value"), ((turn * 20).cast("double") / 100).alias("confidence"),
        F.when(turn % 4 == 3, "session").otherwise("global").alias("scope"))
    again = t.preferences.select(
        (F.col("id") + 1000000).alias("item_id"), "tenant_id", "slot",
        F.when(F.col("id") % 2 == 0, F.col("value")).otherwise(F.concat("value", F.lit(" xtra"))).alias("value"), F.lit(0.5).alias("confidence"), F.lit("global").alias("scope"))
    return said.unionByName(again).withColumn("project_path", F.lit(None).cast("string"))


VALID = """valid AS (SELECT * FROM items WHERE (slot IN ('tone', 'language', 'code_style', 'preferred_tools') OR regexp_matches(slot, '^custom:[a-z0-9_]+$')) AND confidence BETWEEN 0 AND 1
 AND scope IN ('project', 'global') AND regexp_replace(value, '^\\s+|\\s+$', '', 'g') <> '' AND length(value) <= 150)"""


@query("valid_preferences", f"WITH {ITEMS}, {VALID} SELECT item_id, slot, value FROM valid")
def valid_preferences(t):
    return ops.valid_preferences(items(t)).select("item_id", "slot", "value")


MATCH = f"""{ITEMS}, {VALID}, live AS (SELECT * FROM preferences WHERE status <> 'deleted'),
iw AS (SELECT DISTINCT item_id, tenant_id, slot, lower(unnest(regexp_extract_all(value, '[a-zA-Z_]{{3,}}'))) AS w FROM valid), pw AS (SELECT DISTINCT id, tenant_id, slot, lower(unnest(regexp_extract_all(value, '[a-zA-Z_]{{3,}}'))) AS w FROM live),
ni AS (SELECT item_id, count(*) AS n FROM iw GROUP BY 1), np AS (SELECT id, count(*) AS n FROM pw GROUP BY 1),
near AS (SELECT item_id, id FROM iw JOIN pw USING (tenant_id, slot, w) JOIN ni USING (item_id) JOIN np USING (id) GROUP BY 1, 2 HAVING count(*) / (any_value(ni.n) + any_value(np.n) - count(*))::DOUBLE > 0.6
   UNION SELECT item_id, id FROM valid JOIN live USING (tenant_id, slot, value)),
matched AS (SELECT item_id, arg_max(id, (confidence, -id)) AS id FROM near JOIN (SELECT id, confidence FROM live) USING (id) GROUP BY 1)"""


@query("apply_induction_reinforced", f"WITH {MATCH} SELECT id, count(*) AS hits, round(least(any_value(confidence) + 0.15::DOUBLE * count(*), 0.95), 6) AS confidence FROM matched JOIN (SELECT id, confidence FROM live) USING (id) GROUP BY id")
def apply_reinforced(t):
    return ops.apply_induction(t.preferences, items(t), AS_OF)[0].select("id", "hits", F.round("confidence", 6).alias("confidence"))


@query("apply_induction_created", f"WITH {MATCH} SELECT item_id, slot, value, sha256(concat(tenant_id, '/', item_id)) AS id FROM valid WHERE item_id NOT IN (SELECT item_id FROM matched)")
def apply_created(t):
    return ops.apply_induction(t.preferences, items(t), AS_OF)[1].select("item_id", "slot", "value", "id")


RUN_TIME = 1705708800  # 2024-01-20


@query("induction_eligible", f"""WITH t AS (SELECT DISTINCT user_id AS tenant_id, user_id <> 'tenant-1' AS enabled FROM sharing_events),
r AS (SELECT user_id AS tenant_id, max(epoch(ts)) AS last_s FROM sharing_events WHERE action IN ('share', 'pull') AND epoch(ts) < {RUN_TIME} GROUP BY 1), c AS (SELECT tenant_id, count(*) AS n FROM memories GROUP BY 1),
j AS (SELECT t.*, CASE WHEN NOT enabled THEN 'disabled' WHEN floor({RUN_TIME} - floor(last_s)) < 600 THEN 'cooldown' WHEN coalesce(n, 0) < 5 THEN 'not_enough_candidates' ELSE 'ok' END AS reason FROM t LEFT JOIN r USING (tenant_id) LEFT JOIN c USING (tenant_id))
SELECT tenant_id, reason, reason = 'ok' AS eligible FROM j""")
def induction_eligible(t):
    tenants = t.sharing_events.select(F.col("user_id").alias("tenant_id")).distinct().withColumn("enabled", F.col("tenant_id") != "tenant-1")
    runs = induction_runs(t).filter(F.unix_seconds("started_at") < RUN_TIME)
    locks = t.sharing_events.select(F.col("user_id").alias("tenant_id"), F.timestamp_seconds(F.lit(RUN_TIME - 1)).alias("expires_at"))
    return ops.induction_eligible(tenants, runs, locks, t.memory, RUN_TIME)


REQUESTS = "requests AS (SELECT DISTINCT tenant_id, project_path AS project FROM memory_queries)"


def requests(t):
    return t.memory_queries.select("tenant_id", F.col("project_path").alias("project")).distinct()


@query("preferences_for", f"WITH {REQUESTS} SELECT r.tenant_id, r.project, id, slot, confidence FROM requests r JOIN preferences p ON p.tenant_id = r.tenant_id AND status <> 'deleted' AND (scope = 'global' OR p.project_path = r.project)")
def preferences_for(t):
    return ops.preferences_for(t.preferences, requests(t)).select("tenant_id", "project", "id", "slot", "confidence")


@query("profile_text", f"""WITH {REQUESTS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY confidence DESC, id) AS rn FROM preferences WHERE status = 'active' AND scope = 'global') WHERE rn <= 20),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, project_path ORDER BY confidence DESC, id) AS rn FROM preferences WHERE status = 'active' AND scope = 'project') WHERE rn <= 10),
s AS (SELECT r.tenant_id, coalesce(project, '') AS project, id, slot, value, confidence FROM requests r JOIN g USING (tenant_id) UNION ALL SELECT r.tenant_id, coalesce(project, ''), id, slot, value, confidence FROM requests r JOIN p ON p.tenant_id = r.tenant_id AND p.project_path = r.project),
b AS (SELECT *, sum(strlen(concat('· ', slot, ' — ', value)) + 1) OVER (PARTITION BY tenant_id, project ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM s),
x AS (SELECT tenant_id, project, count(*) AS n, '## User Profile' || chr(10) || string_agg(concat('- ', slot, ': ', value), chr(10) ORDER BY confidence DESC, id) AS content FROM b WHERE used <= 3000 GROUP BY 1, 2)
SELECT DISTINCT r.tenant_id, coalesce(r.project, '') AS project, coalesce(content, '') AS content, coalesce(n, 0) AS preferences, strlen(coalesce(content, '')) // 4 AS tokens FROM requests r LEFT JOIN x ON x.tenant_id = r.tenant_id AND x.project = coalesce(r.project, '')""")
def profile_text(t):
    return ops.profile_text(t.preferences, requests(t))


@query("profile_snapshot")
def profile_snapshot(t):
    return ops.profile_snapshot(t.preferences, 100)


EDITS = """edits AS (SELECT CASE WHEN quality = 0 THEN 'delete' WHEN toxic = 1 THEN 'create' ELSE 'update' END AS op, CASE WHEN toxic = 1 AND quality = 1 THEN doc_id + 1000000 ELSE doc_id END AS id, doc_id FROM labels)"""


def upserted(t):
    op = F.when(F.col("quality") == 0, "delete").when(F.col("toxic") == 1, "create").otherwise("update")
    edits = t.labels.select(
        op.alias("op"), F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("id"), F.lit("tenant-9").alias("tenant_id"),
        F.lit("tone").alias("slot"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("value"), F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("project_path"), F.lit(None).cast("string").alias("status"))
    return ops.upsert_preferences(typed_preferences(t), edits, AS_OF)


@query("upsert_preferences", f"""WITH {EDITS} SELECT p.id, CASE op WHEN 'update' THEN 'tone' ELSE slot END AS slot, CASE op WHEN 'update' THEN 'v' || p.id ELSE value END AS value, confidence, CASE op WHEN 'delete' THEN 'deleted' ELSE status END AS status
 FROM preferences p LEFT JOIN edits e ON e.id = p.id AND op <> 'create' UNION ALL SELECT id, 'tone', 'v' || doc_id, 0.9, 'active' FROM edits WHERE op = 'create'""")
def upsert_preferences(t):
    return upserted(t)[0].select("id", "slot", "value", "confidence", "status")


@query("upsert_preferences_log", f"""WITH {EDITS} SELECT p.id AS preference_id, op || 'd' AS action, value AS old_value, CASE op WHEN 'update' THEN 'v' || p.id END AS new_value FROM preferences p JOIN edits e ON e.id = p.id AND op <> 'create'
 UNION ALL SELECT id, 'created', NULL, 'v' || doc_id FROM edits WHERE op = 'create'""")
def upsert_log(t):
    return upserted(t)[1].select("preference_id", "action", "old_value", "new_value")
