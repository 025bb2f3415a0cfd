from pyspark.sql import functions as F

from ..operators import sharing as ops
from .graph import ACCESS
from .registry import query
from .views import AS_OF


def memories(t):
    return t.memory.withColumn("shared_from_space", F.lit("team/t1")).withColumn(
        "shared_by_user", F.when(F.col("shared_from_memory").isNotNull(), F.concat(F.lit("tenant-"), (F.col("id") % 2).cast("string")))
    ).withColumn("shared_by_agent", F.lit("agent-1")).withColumn("shared_at", F.col("created_at")).withColumn(
        "original_created_at", F.col("created_at")).withColumn("id", F.col("id").cast("string")).withColumn(
        "shared_from_memory", F.col("shared_from_memory").cast("string"))


def requests(t):
    return t.sharing_events.filter("action IN ('share', 'batch_share')").select(
        F.col("memory_id").cast("string").alias("memory_id"), F.col("to_space").alias("target_space"), "user_id", "agent_id")


COPY_ID = "sha256(concat('copy/', {id}, '/', {space}))"
SHARE = f"""asked AS (SELECT * FROM (SELECT memory_id, to_space AS target_space, user_id, agent_id, row_number() OVER (PARTITION BY memory_id, to_space ORDER BY user_id, agent_id) AS rn FROM sharing_events WHERE action IN ('share', 'batch_share')) WHERE rn = 1),
copies AS (SELECT shared_from_memory AS memory_id, space_id AS target_space, min(id::VARCHAR) AS existing_id FROM memories WHERE shared_from_memory IS NOT NULL GROUP BY 1, 2),
results AS (SELECT a.*, existing_id, CASE WHEN existing_id IS NULL THEN 'shared' ELSE 'existing' END AS status FROM asked a LEFT JOIN copies USING (memory_id, target_space))"""


@query("share_results", f"WITH {SHARE} SELECT memory_id::VARCHAR AS memory_id, target_space, user_id, existing_id, status FROM results")
def share_results(t):
    return ops.share(requests(t), memories(t), AS_OF).results.select("memory_id", "target_space", "user_id", "existing_id", "status")


@query("share_summary", f"WITH {SHARE} SELECT target_space, count(*) FILTER (status = 'shared') AS shared, count(*) FILTER (status = 'existing') AS skipped, 0::BIGINT AS failed FROM results GROUP BY 1")
def share_summary(t):
    return ops.share_summary(ops.share(requests(t), memories(t), AS_OF).results)


@query("shared_copy", f"""WITH {SHARE} SELECT {COPY_ID.format(id='m.id', space='target_space')} AS id, content, target_space AS space_id, 'global' AS visibility, m.id::VARCHAR AS shared_from_memory, m.space_id AS shared_from_space,
 user_id AS shared_by_user, m.version AS source_version, 1::BIGINT AS version, 0::INT AS access_count, NULL::VARCHAR AS project_path, {AS_OF}::BIGINT AS created_s FROM results r JOIN memories m ON m.id = r.memory_id WHERE status = 'shared'""")
def shared_copy(t):
    return ops.share(requests(t), memories(t), AS_OF).copies.select(
        "id", "content", "space_id", "visibility", "shared_from_memory", "shared_from_space", "shared_by_user", "source_version", "version", "access_count",
        "project_path", F.unix_seconds("created_at").alias("created_s"))


@query("share_events", f"""WITH {SHARE} SELECT sha256(concat('batch_share/', {COPY_ID.format(id='m.id', space='target_space')}, '/', target_space, '/', user_id)) AS id, m.space_id AS from_space, target_space AS to_space, user_id,
 CASE WHEN strlen(content) > 100 THEN concat((SELECT max(left(content, k)) FROM unnest(range(1, 98)) u(k) WHERE strlen(left(content, k)) <= 97), '...') ELSE content END AS content_preview FROM results r JOIN memories m ON m.id = r.memory_id WHERE status = 'shared'""")
def share_events(t):
    return ops.share(requests(t), memories(t), AS_OF).events.select("id", "from_space", "to_space", "user_id", "content_preview")


@query("share_filter", "SELECT id FROM memories WHERE category IN ('work', 'decisions') AND importance >= 0.3 AND id IN (SELECT id FROM memory_tags WHERE tag IN ('hot', 'fr'))")
def share_filter(t):
    return ops.share_filter(t.memory, ("work", "decisions"), ("hot", "fr"), 0.3).select("id")


@query("pull", f"""WITH a AS (SELECT DISTINCT memory_id, user_id FROM sharing_events WHERE action = 'pull'), c AS (SELECT DISTINCT shared_from_memory AS memory_id, space_id FROM memories WHERE shared_from_memory IS NOT NULL)
SELECT {COPY_ID.format(id='memory_id', space="'personal/' || user_id")} AS id, 'personal/' || user_id AS space_id, 'private' AS visibility FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.memory_id = a.memory_id AND c.space_id = 'personal/' || user_id)""")
def pull(t):
    asked = t.sharing_events.filter("action = 'pull'").select(F.col("memory_id").cast("string").alias("memory_id"), "user_id", "agent_id")
    return ops.pull(asked, memories(t), AS_OF).copies.select("id", "space_id", "visibility")


@query("unshare", f"""WITH {ACCESS}, a AS (SELECT DISTINCT memory_id, to_space AS target_space, user_id FROM sharing_events),
c AS (SELECT * FROM (SELECT shared_from_memory AS memory_id, space_id AS target_space, id::VARCHAR AS copy_id, 'tenant-' || (id % 2) AS by_user, row_number() OVER (PARTITION BY shared_from_memory, space_id ORDER BY id::VARCHAR) AS rn FROM memories WHERE shared_from_memory IS NOT NULL) WHERE rn = 1)
SELECT a.memory_id::VARCHAR AS memory_id, a.target_space, a.user_id, copy_id, CASE WHEN copy_id IS NULL THEN 'not_found' WHEN by_user = a.user_id OR role IN ('owner', 'admin') THEN 'removed' ELSE 'refused' END AS status
FROM a LEFT JOIN c USING (memory_id, target_space) LEFT JOIN access x ON x.user_id = a.user_id AND x.space_id = a.target_space""")
def unshare(t):
    asked = t.sharing_events.select(F.col("memory_id").cast("string").alias("memory_id"), F.col("to_space").alias("target_space"), "user_id")
    return ops.unshare(asked, memories(t), t.spaces, t.space_members)


@query("reshare", f"""SELECT {COPY_ID.format(id='s.id', space='m.space_id')} AS id, s.content, m.space_id, s.version AS source_version FROM memories m JOIN memories s ON s.id = m.shared_from_memory WHERE m.source_version < s.version""")
def reshare(t):
    return ops.reshare(memories(t), AS_OF)[0].select("id", "content", "space_id", "source_version")


def rules(t):
    def listed(name):
        return F.when(F.col(name).isNull(), F.array().cast("array<string>")).otherwise(F.array(name))
    return t.share_rules.withColumn("categories", listed("category")).withColumn("tags", listed("tag"))


@query("auto_share", f"""WITH {ACCESS}, h AS (SELECT m.id AS memory_id, r.space_id AS target_space, m.tenant_id AS user_id, rule_id FROM memories m JOIN share_rules r ON r.source_space = m.space_id AND NOT require_approval
  AND (r.category IS NULL OR r.category = m.category) AND (r.tag IS NULL OR EXISTS (SELECT 1 FROM memory_tags g WHERE g.id = m.id AND g.tag = r.tag)) AND m.importance >= min_importance JOIN access a ON a.user_id = m.tenant_id AND a.space_id = r.space_id)
SELECT memory_id, target_space, user_id, min(rule_id) AS rule_id FROM h WHERE NOT EXISTS (SELECT 1 FROM memories c WHERE c.shared_from_memory = h.memory_id AND c.space_id = h.target_space) GROUP BY 1, 2, 3""")
def auto_share(t):
    return ops.auto_share(t.memory, t.spaces, t.space_members, rules(t), AS_OF, t.memory)


@query("share_to_users", f"""WITH {ACCESS}, p AS (SELECT user_id AS user_a, 'tenant-' || (memory_id % 3) AS user_b, memory_id FROM sharing_events),
f AS (SELECT user_a, user_b, min(a.space_id) AS found FROM (SELECT DISTINCT user_a, user_b FROM p) JOIN access a ON a.user_id = user_a AND a.space_type = 'team' JOIN access b ON b.user_id = user_b AND b.space_id = a.space_id GROUP BY 1, 2),
q AS (SELECT DISTINCT memory_id, coalesce(found, concat('team/', left(sha256(user_a || '|' || user_b), 32))) AS target_space FROM p LEFT JOIN f USING (user_a, user_b))
SELECT target_space, count(*) FILTER (NOT hit) AS shared, count(*) FILTER (hit) AS skipped, 0::BIGINT AS failed FROM (SELECT *, EXISTS (SELECT 1 FROM memories c WHERE c.shared_from_memory = q.memory_id AND c.space_id = q.target_space) AS hit FROM q) GROUP BY 1""")
def share_to_users(t):
    pairs = t.sharing_events.select(
        F.col("user_id").alias("user_a"), F.concat(F.lit("tenant-"), (F.col("memory_id") % 3).cast("string")).alias("user_b"),
        F.col("memory_id").cast("string").alias("memory_id"))
    shared, _ = ops.share_to_users(pairs, memories(t), t.spaces, t.space_members, AS_OF)
    return ops.share_summary(shared.results)
