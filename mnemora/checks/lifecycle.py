from pyspark.sql import functions as F

from ..functions.scoring import Decay
from ..operators import lifecycle as ops
from ..plans.lifecycle import lifecycle_run
from .registry import query
from .views import AS_OF

LOW = Decay(floor_core=0.05, floor_working=0.04, floor_peripheral=0.03, stale_threshold=0.45)


def decay_sql(low=False, importance="importance", source="memories"):
    floors = (0.05, 0.04, 0.03) if low else (0.9, 0.7, 0.5)
    return f"""
d AS (SELECT *, {importance} AS imp,
    greatest(({AS_OF} - coalesce(last_accessed_s, created_s)) / 86400.0::DOUBLE, 0) AS idle_days,
    greatest((coalesce(last_accessed_s, created_s) - created_s) / 86400.0::DOUBLE, 0) AS span_days,
    CASE tier WHEN 'core' THEN 0.8::DOUBLE WHEN 'working' THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END AS beta,
    CASE tier WHEN 'core' THEN {floors[0]}::DOUBLE WHEN 'working' THEN {floors[1]}::DOUBLE ELSE {floors[2]}::DOUBLE END AS tier_floor
  FROM {source}),
e AS (SELECT *, exp(-(ln(2::DOUBLE) / (30::DOUBLE * exp(1.5::DOUBLE * imp))) * pow(idle_days, beta)) AS recency,
    (1 - exp(-access_count / 5::DOUBLE)) * CASE WHEN access_count > 1
       THEN 0.5::DOUBLE + 0.5::DOUBLE * exp(-(span_days / (access_count - 1)) / 30::DOUBLE) ELSE 1::DOUBLE END AS frequency,
    imp * confidence AS intrinsic FROM d),
scored AS (SELECT *, 0.4::DOUBLE * recency + 0.3::DOUBLE * frequency + 0.3::DOUBLE * intrinsic AS raw_strength,
    greatest(0.4::DOUBLE * recency + 0.3::DOUBLE * frequency + 0.3::DOUBLE * intrinsic, tier_floor) AS strength FROM e)"""


def tiers_sql(low=True):
    lifted = "least(1::DOUBLE, greatest(importance, 0.5::DOUBLE + access_count * 0.05::DOUBLE))"
    return f"""
WITH {decay_sql(low)},
up AS (WITH {decay_sql(low, lifted)} SELECT id, strength AS lifted_strength, imp AS lifted FROM scored),
judged AS (SELECT s.*, CASE
    WHEN state <> 'active' THEN tier
    WHEN tier = 'peripheral' AND access_count >= 6 AND lifted_strength >= 0.4 THEN 'working'
    WHEN tier = 'working' AND access_count >= 10 AND lifted_strength >= 0.7 AND lifted >= 0.8 THEN 'core'
    WHEN tier IN ('working', 'core') AND visibility <> 'private' AND raw_strength < 0.2 AND idle_days > 90
      THEN CASE tier WHEN 'core' THEN 'working' ELSE 'peripheral' END
    ELSE tier END AS new_tier FROM scored s JOIN up USING (id))"""


@query("decay_scores", f"""WITH {decay_sql()}
SELECT id, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(intrinsic, 6) AS intrinsic,
  round(raw_strength, 6) AS raw_strength, round(strength, 6) AS strength, strength < 0.3 AS stale FROM scored""")
def decay_scores(t):
    parts = ["recency", "frequency", "intrinsic", "raw_strength", "strength"]
    return ops.decay_scores(t.memory, AS_OF).select("id", *[F.round(c, 6).alias(c) for c in parts], "stale")


@query("evaluate_tiers", tiers_sql(low=False) + " SELECT id, tier, new_tier FROM judged")
def evaluate_tiers(t):
    return ops.evaluate_tiers(t.memory, AS_OF).select("id", "tier", "new_tier")


@query("evaluate_tiers_low_floors", tiers_sql() + " SELECT id, tier, new_tier FROM judged")
def evaluate_tiers_low(t):
    return ops.evaluate_tiers(t.memory, AS_OF, LOW).select("id", "tier", "new_tier")


def seeded(t):
    """Memories with one earlier history entry."""
    return t.memory.withColumn("tier_history", F.array(F.struct(
        F.lit("peripheral").alias("from"), F.col("tier").alias("to"), F.lit("seed").alias("reason"),
        F.col("created_s").cast("string").alias("at"), F.lit(0).cast("bigint").alias("access_count"),
    )))


def with_changes(t):
    return ops.append_tier_history(ops.evaluate_tiers(seeded(t), AS_OF, LOW), AS_OF)


HISTORY = tiers_sql() + """,
history AS (
  SELECT id, content, l0_abstract, state, 'peripheral' AS "from", tier AS "to", 'seed' AS reason, created_s::VARCHAR AS "at", 0::BIGINT AS access_count FROM judged
  UNION ALL SELECT id, content, l0_abstract, state, tier, new_tier, 'auto evaluation', '2024-08-01 00:00:00', access_count FROM judged WHERE tier <> new_tier)"""


@query("append_tier_history", HISTORY + """, n AS (SELECT id, count(*) AS entries FROM history GROUP BY id)
SELECT id, new_tier AS tier, entries FROM judged JOIN n USING (id)""")
def append_tier_history(t):
    return with_changes(t).select("id", "tier", F.size("tier_history").cast("bigint").alias("entries"))


@query("tier_changes", HISTORY + """,
r AS (SELECT *, CASE "from" WHEN 'core' THEN 2 WHEN 'working' THEN 1 ELSE 0 END AS a,
   CASE "to" WHEN 'core' THEN 2 WHEN 'working' THEN 1 ELSE 0 END AS b,
   CASE WHEN l0_abstract = '' THEN substr(content, 1, 40) ELSE l0_abstract END AS title FROM history WHERE state = 'active')
SELECT id, title, "from", "to", reason, "at", access_count FROM r
WHERE b > a AND contains(lower(concat_ws(' ', id::VARCHAR, title, "from", "to", reason)), 'auto')""")
def tier_changes(t):
    return ops.tier_changes(with_changes(t), "promote", "Auto")


@query("drop_history_entry", HISTORY + """, n AS (SELECT id, count(*) AS entries FROM history WHERE reason <> 'seed' GROUP BY id)
SELECT id, coalesce(entries, 0) AS entries FROM judged LEFT JOIN n USING (id)""")
def drop_history_entry(t):
    removals = t.memory.select(
        "id", F.lit("peripheral").alias("from"), F.col("tier").alias("to"),
        F.col("created_s").cast("string").alias("at"), F.lit("seed").alias("reason"))
    return ops.drop_history_entry(with_changes(t), removals).select(
        "id", F.size("tier_history").cast("bigint").alias("entries"))


TTL = """ttl AS (SELECT *, CASE
  WHEN contains(lower(content), 'today') OR contains(content, '今天') THEN 2
  WHEN contains(lower(content), 'tomorrow') OR contains(content, '明天') THEN 2
  WHEN contains(lower(content), 'next week') OR contains(content, '下周') THEN 10
  WHEN contains(lower(content), 'this month') OR contains(content, '这个月') THEN 35 END AS ttl_days FROM dated)"""
# The driver's prose has no time words: a sentence with one is put in front of each text.
DATED = """dated AS (SELECT * REPLACE (concat(CASE id % 5 WHEN 0 THEN 'Do it Today. ' WHEN 1 THEN '明天见. '
  WHEN 2 THEN 'Next Week we ship. ' WHEN 3 THEN 'Done this month. ' ELSE '' END, content) AS content) FROM memories)"""


def dated(t):
    kind = F.col("id") % 5
    words = (F.when(kind == 0, "Do it Today. ").when(kind == 1, "明天见. ").when(kind == 2, "Next Week we ship. ")
             .when(kind == 3, "Done this month. ").otherwise(""))
    return t.memory.withColumn("content", F.concat(words, "content"))


@query("detect_ttl", f"WITH {DATED}, {TTL} SELECT id, ttl_days FROM ttl")
def detect_ttl(t):
    return dated(t).select("id", ops.detect_ttl(F.col("content")).alias("ttl_days"))


@query("expired", f"WITH {DATED}, {TTL} SELECT id FROM ttl WHERE created_s + ttl_days * 86400 < {AS_OF}")
def expired(t):
    return ops.expired(dated(t), AS_OF).select("id")


@query("archive_superseded", f"""SELECT id, CASE WHEN superseded_by IS NOT NULL AND {AS_OF} - created_s > 30 * 86400
  THEN 'archived' ELSE state END AS state FROM memories""")
def archive_superseded(t):
    return ops.archive_superseded(t.memory, AS_OF).select("id", "state")


STALE = f"WITH {decay_sql(low=True)}, stale AS (SELECT * FROM scored WHERE state = 'active' AND memory_type <> 'pinned' AND access_count < 5 AND strength < 0.45)"


@query("stale", STALE + " SELECT id, round(raw_strength, 6) AS raw_strength FROM stale")
def stale(t):
    return ops.decay_scores(ops.stale(t.memory, AS_OF, LOW), AS_OF, LOW).select(
        "id", F.round("raw_strength", 6).alias("raw_strength"))


@query("stale_default_floors", f"WITH {decay_sql()} SELECT id FROM scored WHERE state = 'active' AND memory_type <> 'pinned' AND access_count < 5 AND strength < 0.3")
def stale_default(t):
    return ops.stale(t.memory, AS_OF).select("id")


@query("capped_delete", STALE + """, n AS (SELECT id, space_id, row_number() OVER (PARTITION BY space_id ORDER BY id) AS rn FROM stale)
SELECT id, space_id FROM n WHERE rn <= 20""")
def capped_delete(t):
    return ops.cap_per_space(ops.stale(t.memory, AS_OF, LOW), 20).select("id", "space_id")


@query("decay_curve", """WITH p AS (SELECT id, ln(2::DOUBLE) / (30::DOUBLE * exp(1.5::DOUBLE * importance)) AS rate,
  CASE tier WHEN 'core' THEN 0.8::DOUBLE WHEN 'working' THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END AS beta,
  CASE tier WHEN 'core' THEN 0.9::DOUBLE WHEN 'working' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS low FROM memories)
SELECT id, d::INT AS day, round(greatest(exp(-rate * pow(d::DOUBLE, beta)), low), 6) AS strength FROM p, unnest(range(90)) AS r(d)""")
def decay_curve(t):
    return ops.decay_curve(t.memory).withColumn("strength", F.round("strength", 6))


def typed_preferences(t):
    stamp = F.timestamp_seconds("reinforced_s")
    return t.preferences.withColumn("last_reinforced_at", stamp).withColumn("updated_at", stamp)


DORMANT = f"status IN ('active', 'reinforce') AND {AS_OF} - reinforced_s > 90 * 86400"
PURGED = f"status = 'dormant' AND {AS_OF} - reinforced_s > 180 * 86400"


@query("dormant_preferences", f"SELECT id, CASE WHEN {DORMANT} THEN 'dormant' ELSE status END AS status FROM preferences")
def dormant_preferences(t):
    return ops.dormant_preferences(typed_preferences(t), AS_OF)[0].select("id", "status")


@query("purge_preferences", f"SELECT id AS preference_id, tenant_id, 'deleted' AS action, 'dormant' AS old_value, 'lifecycle_cleanup' AS source FROM preferences WHERE {PURGED}")
def purge_preferences(t):
    return ops.purge_preferences(typed_preferences(t), AS_OF)[1]


@query("lifecycle_run", tiers_sql() + f""",
src AS (SELECT j.*, d.content AS dated_content FROM judged j JOIN (WITH {DATED} SELECT id, content FROM dated) d USING (id)),
f AS (SELECT *, coalesce(created_s + CASE
    WHEN contains(lower(dated_content), 'today') OR contains(dated_content, '今天') THEN 2
    WHEN contains(lower(dated_content), 'tomorrow') OR contains(dated_content, '明天') THEN 2
    WHEN contains(lower(dated_content), 'next week') OR contains(dated_content, '下周') THEN 10
    WHEN contains(lower(dated_content), 'this month') OR contains(dated_content, '这个月') THEN 35 END * 86400 < {AS_OF}, FALSE) AS is_expired,
    CASE WHEN superseded_by IS NOT NULL AND {AS_OF} - created_s > 30 * 86400 THEN 'archived' ELSE state END AS new_state FROM src),
moved AS (SELECT f.* REPLACE (new_tier AS tier) FROM f WHERE NOT is_expired AND new_state = 'active' AND memory_type <> 'pinned' AND access_count < 5),
again AS (WITH {decay_sql(low=True, source='(SELECT * EXCLUDE (imp, idle_days, span_days, beta, tier_floor, recency, frequency, intrinsic, raw_strength, strength) FROM moved)')}
  SELECT id, space_id, strength FROM scored),
capped AS (SELECT id, row_number() OVER (PARTITION BY space_id ORDER BY id) AS rn FROM again WHERE strength < 0.45)
SELECT space_id, count(*) FILTER (tier <> new_tier) AS tier_changes, count(*) FILTER (is_expired) AS expired,
  count(*) FILTER (new_state <> state AND NOT is_expired) AS archived,
  count(*) FILTER (f.id IN (SELECT id FROM capped WHERE rn <= 10)) AS stale_deleted
FROM f GROUP BY space_id""")
def lifecycle(t):
    memories = dated(t).withColumn("tier_history", F.lit(None).cast(
        "array<struct<from:string,to:string,reason:string,at:string,access_count:bigint>>"))
    return lifecycle_run(memories, AS_OF, typed_preferences(t), LOW, delete_cap=10).summary
