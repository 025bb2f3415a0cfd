from pyspark.sql import functions as F

from ..operators import updates
from .registry import query
from .views import AS_OF


def changes(t):
    """New texts for documents with labels, and one new memory per labelled document of bad quality."""
    labelled = t.labels.join(t.memory, t.labels.doc_id == t.memory.id)
    cols = t.memory.columns
    updated = labelled.withColumn("content", F.concat(F.lit("new "), "content")).select(*cols)
    added = labelled.filter("quality = 0").withColumn("id", F.col("id") + 1_000_000).select(*cols)
    return updated.unionByName(added)


@query("upsert_memories", f"""WITH c AS (SELECT m.* REPLACE ('new ' || content AS content) FROM memories m JOIN labels ON doc_id = id
 UNION ALL SELECT m.* REPLACE (id + 1000000 AS id) FROM memories m JOIN labels ON doc_id = id WHERE quality = 0)
SELECT id, content, version, created_s AS updated_s FROM memories WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT c.id, c.content, CASE WHEN m.id IS NULL THEN c.version ELSE m.version + 1 END, CASE WHEN m.id IS NULL THEN c.created_s ELSE {AS_OF} END FROM c LEFT JOIN memories m ON m.id = c.id""")
def upsert_memories(t):
    return updates.upsert_memories(t.memory, changes(t), AS_OF).select(
        "id", "content", "version", F.unix_seconds("updated_at").alias("updated_s"))


@query("delete_memories", "SELECT id FROM memories WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_memories(t):
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return updates.delete_memories(t.memory, gone).select("id")


@query("remap_project_path", """SELECT id, coalesce(project_path = '/srv/app' AND visibility <> 'private' AND category <> 'preferences', FALSE) AS moved,
 CASE WHEN project_path = '/srv/app' AND visibility <> 'private' AND category <> 'preferences' THEN '/srv/new' ELSE project_path END AS project_path FROM memories""")
def remap_project_path(t):
    return updates.remap_project_path(t.memory, "/srv/new", "/srv/app").select("id", "moved", "project_path")


@query("remap_project_path_unbound", """SELECT id, CASE WHEN project_path IS NULL AND visibility <> 'private' AND category <> 'preferences' THEN '/srv/new' ELSE project_path END AS project_path FROM memories""")
def remap_unbound(t):
    return updates.remap_project_path(t.memory, "/srv/new").select("id", "project_path")


def listed_paths(t):
    return t.spark.sql("SELECT explode(array('/srv', '/opt/other')) AS path")


@query("nullify_project_path", "SELECT id, CASE WHEN project_path IN ('/srv', '/opt/other') THEN NULL ELSE project_path END AS project_path FROM memories")
def nullify_project_path(t):
    return updates.nullify_project_path(t.memory, listed_paths(t)).select("id", "project_path")


@query("nullify_preview", "SELECT project_path, count(*) AS n FROM memories WHERE project_path IN ('/srv', '/opt/other') GROUP BY project_path")
def nullify_preview(t):
    return updates.nullify_preview(t.memory, listed_paths(t))


@query("set_visibility", """WITH c AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'shared:team/t1' END AS visibility,
  CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 OR doc_id % 2 = 0 THEN 'private' ELSE 'team' END END AS scope, CASE WHEN doc_id % 3 = 0 THEN 'agent-9' END AS agent_id FROM labels),
j AS (SELECT m.id, m.owner_agent_id, CASE WHEN c.scope = 'private' THEN 'private' WHEN c.scope IS NOT NULL THEN 'global' ELSE coalesce(c.visibility, m.visibility) END AS visibility,
  coalesce(c.scope, m.scope) AS scope, c.id IS NOT NULL AS hit, c.agent_id, (SELECT count(*) FROM memory_tags g WHERE g.id = m.id) + CASE WHEN c.scope = 'private' THEN 1 ELSE 0 END AS n_tags
  FROM memories m LEFT JOIN c ON c.id = m.id)
SELECT id, visibility, scope, n_tags, CASE WHEN hit AND visibility = 'private' THEN coalesce(agent_id, owner_agent_id) ELSE owner_agent_id END AS owner_agent_id FROM j""")
def set_visibility(t):
    wanted = t.labels.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "shared:team/t1").alias("visibility"),
        F.when(F.col("quality") == 1, F.when((F.col("toxic") == 1) | (F.col("doc_id") % 2 == 0), "private").otherwise("team")).alias("scope"),
        F.when(F.col("doc_id") % 3 == 0, "agent-9").alias("agent_id"))
    return updates.set_visibility(t.memory, wanted).select(
        "id", "visibility", "scope", "owner_agent_id", F.size("tags").cast("bigint").alias("n_tags"))


@query("bump_access", f"""WITH h AS (SELECT memory_id AS id, count(DISTINCT event_id) AS hits FROM recall_items WHERE is_kept GROUP BY memory_id)
SELECT id, CAST(access_count + coalesce(hits, 0) AS INT) AS access_count, CASE WHEN hits IS NULL THEN last_accessed_s ELSE {AS_OF} END AS last_accessed_s FROM memories LEFT JOIN h USING (id)""")
def bump_access(t):
    hits = t.recall_items.filter("is_kept").select(F.col("memory_id").alias("id"), F.col("event_id").alias("batch_id"))
    return updates.bump_access(t.memory, hits, AS_OF).select(
        "id", "access_count", F.unix_seconds("last_accessed_at").alias("last_accessed_s"))


@query("apply_patch", f"""WITH p AS (SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'patched ' || doc_id END AS content, CASE WHEN toxic = 1 THEN 'archived' END AS state FROM labels)
SELECT m.id, coalesce(p.content, m.content) AS content, coalesce(p.content, m.content) AS l2_content, coalesce(p.state, m.state) AS state,
  CASE WHEN p.id IS NULL THEN version ELSE version + 1 END AS version FROM memories m LEFT JOIN p USING (id)""")
def apply_patch(t):
    patches = t.labels.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 0, F.concat(F.lit("patched "), F.col("doc_id").cast("string"))).alias("content"),
        F.when(F.col("toxic") == 1, "archived").alias("state"))
    memories = t.memory.withColumn("l2_content", F.col("content"))
    return updates.apply_patch(memories, patches, AS_OF).select("id", "content", "l2_content", "state", "version")


@query("create_defaults", f"""SELECT sha256(concat(tenant_id, chr(1), content)) AS id, content AS l2_content, 'pinned' AS memory_type, 'peripheral' AS tier, 0.5::DOUBLE AS importance,
 visibility, CASE WHEN visibility <> 'private' THEN project_path END AS project_path, 1::BIGINT AS version, {AS_OF}::BIGINT AS created_s FROM memories""")
def create_defaults(t):
    rows = t.memory.select("content", "tenant_id", "visibility", "project_path")
    return updates.create_defaults(rows, AS_OF).select(
        "id", "l2_content", "memory_type", "tier", "importance", "visibility", "project_path", "version",
        F.unix_seconds("created_at").alias("created_s"))
