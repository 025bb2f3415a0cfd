from pyspark.sql import functions as F

from ..operators import filters, ranking
from ..operators.filters import DeleteFilter, ListFilter
from .registry import query
from .views import AS_OF

BRIEF = ["id", "category", "state", "project_path"]


@query("filter_memories", """SELECT id, category, state, project_path FROM memories WHERE state = 'active' AND memory_type = 'insight'
 AND visibility = 'global' AND id IN (SELECT id FROM memory_tags WHERE tag = 'hot') AND id IN (SELECT id FROM memory_tags WHERE tag = 'en')
 AND (project_path = '/srv/app' OR starts_with(project_path, '/srv/app/') OR starts_with('/srv/app', project_path || '/')) AND tier = 'core'""")
def filter_memories(t):
    wanted = ListFilter(state="active", memory_type="insight", visibility="global", tags=("hot", "en"),
                        project_path="/srv/app", tier="core", global_scope="exclude")
    return filters.filter_memories(t.memory, wanted).select(*BRIEF)


@query("visible_to", """SELECT id, visibility, owner_agent_id FROM memories
 WHERE visibility = 'global' OR (visibility = 'private' AND owner_agent_id = 'agent-2') OR visibility = 'shared:team/t1'""")
def visible_to(t):
    return filters.visible_to(t.memory, "agent-2", ["team/t1"]).select("id", "visibility", "owner_agent_id")


@query("visible_to_each", """WITH agents AS (SELECT DISTINCT owner_agent_id AS agent_id FROM memories)
SELECT agent_id, id FROM agents JOIN memories ON visibility = 'global' OR (visibility = 'private' AND owner_agent_id = agent_id)
  OR (visibility = 'shared:team/t1' AND agent_id <> 'agent-4')""")
def visible_to_each(t):
    spaces = F.when(F.col("owner_agent_id") != "agent-4", F.array(F.lit("team/t1"))).otherwise(
        F.array().cast("array<string>"))
    agents = t.memory.select("owner_agent_id").distinct().select(F.col("owner_agent_id").alias("agent_id"), spaces.alias("spaces"))
    return filters.visible_to_each(t.memory.select("id", "visibility", "owner_agent_id"), agents).select("agent_id", "id")


@query("project_scope", """SELECT id, project_path FROM memories WHERE project_path IS NULL OR project_path = '/srv/app'
 OR starts_with(project_path, '/srv/app/') OR starts_with('/srv/app', project_path || '/') OR visibility = 'private'""")
def project_scope(t):
    return filters.project_scope(t.memory, "/srv/app").select("id", "project_path")


@query("global_scope_only", "SELECT id FROM memories WHERE project_path IS NULL")
def global_only(t):
    return t.memory.filter(filters.in_global_scope("only")).select("id")


@query("global_scope_exclude", "SELECT id FROM memories WHERE project_path IS NOT NULL AND project_path <> ''")
def global_exclude(t):
    return t.memory.filter(filters.in_global_scope("exclude")).select("id")


@query("has_all_tags", "SELECT id FROM memory_tags WHERE tag IN ('hot', 'fr') GROUP BY id HAVING count(DISTINCT tag) = 2")
def has_all_tags(t):
    return filters.has_all_tags(t.memory, ["hot", "fr"]).select("id")


DELETE = f"""coalesce(starts_with(source, 'ing') AND category = 'work' AND state = 'active' AND memory_type = 'insight'
  AND created_s < {AS_OF - 60 * 86400} AND id IN (SELECT id FROM memory_tags WHERE tag = 'en'), FALSE)"""
DELETE_FILTER = DeleteFilter("ing", ("en",), "work", "insight", "active", AS_OF - 60 * 86400)


@query("delete_preview", f"SELECT count(*) AS would_delete FROM memories WHERE {DELETE}")
def delete_preview(t):
    return filters.delete_preview(t.memory, DELETE_FILTER)


@query("delete_where", f"SELECT id, source FROM memories WHERE NOT {DELETE}")
def delete_where(t):
    return filters.delete_where(t.memory, DELETE_FILTER).select("id", "source")


@query("batch_get", "SELECT id, l0_abstract FROM memories WHERE id IN (SELECT memory_id FROM recall_items)")
def batch_get(t):
    return filters.batch_get(t.memory, t.recall_items.select(F.col("memory_id").alias("id"))).select("id", "l0_abstract")


@query("digest", """SELECT id, l0_abstract AS title, category, substr(content, 1, 200) AS preview, created_s AS updated_s,
 (SELECT count(*) FROM memory_tags g WHERE g.id = m.id) AS n_tags FROM memories m ORDER BY created_s DESC, id LIMIT 100""")
def digest(t):
    return filters.digest(t.memory).select(
        "id", "title", "category", "preview", F.unix_seconds("updated_at").alias("updated_s"),
        F.size("tags").cast("bigint").alias("n_tags"))


@query("mask_private", """SELECT id, CASE WHEN hide THEN '[PRIVATE]' ELSE content END AS content, CASE WHEN hide THEN '[PRIVATE]' ELSE l0_abstract END AS l0_abstract
 FROM (SELECT *, scope = 'private' AND space_id IN ('team/t1', 'personal/tenant-1') AS hide FROM memories)""")
def mask_private(t):
    vaults = t.spaces.filter(F.col("space_id").isin("team/t1", "personal/tenant-1")).select("space_id")
    return filters.mask_private(t.memory, vaults).select("id", "content", "l0_abstract")


ODD_PATHS = """CASE id % 7 WHEN 0 THEN '' WHEN 1 THEN '/srv/' WHEN 2 THEN '/a/../b' WHEN 3 THEN 'x;y' WHEN 4 THEN repeat('é', 300) WHEN 5 THEN '/srv/app' ELSE '/home/u--v' END"""


@query("normalize_project_paths", f"""WITH p AS (SELECT id, {ODD_PATHS} AS raw FROM memories)
SELECT id, CASE WHEN raw = '' OR rtrim(raw, '/') IN ('/srv', '/root') THEN NULL ELSE raw END AS project_path,
 CASE WHEN strlen(raw) > 512 THEN 'too_long' WHEN contains(raw, '..') THEN 'path_traversal'
   WHEN contains(raw, '''') OR contains(raw, ';') OR contains(raw, '--') THEN 'invalid_characters' END AS path_problem FROM p""")
def normalize_project_paths(t):
    rows = t.memory.select("id", F.expr(ODD_PATHS).alias("project_path"))
    homes = t.spark.sql("SELECT explode(array('/srv', '/root/')) AS path")
    return filters.normalize_project_paths(rows, homes).select("id", "project_path", "path_problem")


@query("count_where", "SELECT count(*) AS n FROM memories WHERE category = 'work' AND state = 'active'")
def count_where(t):
    return filters.count_where(t.memory, ListFilter(category="work", state="active"))


@query("count_by_session", "SELECT session_id, count(*) AS n FROM memories GROUP BY session_id")
def count_by_session(t):
    return filters.count_by_session(t.memory)


@query("project_paths_all", "SELECT DISTINCT project_path FROM memories WHERE project_path <> ''")
def project_paths_all(t):
    return filters.project_paths(t.memory, None)


@query("project_paths", "SELECT DISTINCT project_path FROM memories WHERE project_path <> '' ORDER BY project_path LIMIT 50")
def project_paths(t):
    return filters.project_paths(t.memory)


@query("reembed_worklist", "SELECT id, CASE WHEN l0_abstract <> '' THEN l0_abstract ELSE content END AS embed_text FROM memories")
def reembed_worklist(t):
    return filters.reembed_worklist(t.memory)


@query("list_page", "SELECT id, importance FROM memories ORDER BY importance DESC, id LIMIT 25 OFFSET 50")
def list_page(t):
    return ranking.list_page(t.memory, "importance", True, 25, 50).select("id", "importance")


@query("list_page_total", "SELECT count(*) AS total_count FROM memories WHERE tier = 'core'")
def list_page_total(t):
    return ranking.page_total(filters.filter_memories(t.memory, ListFilter(tier="core")))


# recall items stand in for scored hits: event = query, two legs
HITS = """hits AS (SELECT memory_id % 50 AS query_id, CASE WHEN is_kept THEN 'vector' ELSE 'text' END AS leg, item_id AS memory_id, score FROM recall_items)"""


def hits(t):
    return t.recall_items.select(
        (F.col("memory_id") % 50).alias("query_id"), F.when(F.col("is_kept"), "vector").otherwise("text").alias("leg"),
        F.col("item_id").alias("memory_id"), "score")


@query("rank_leg", f"WITH {HITS} SELECT query_id, leg, memory_id, score, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, memory_id) AS rank FROM hits")
def rank_leg(t):
    return ranking.rank_leg(hits(t)).withColumn("rank", F.col("rank").cast("bigint"))


@query("minmax", f"""WITH {HITS}, b AS (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi, count(*) OVER (PARTITION BY query_id) AS n FROM hits)
SELECT query_id, memory_id, round(CASE WHEN n = 1 THEN least(score * 120, 1) WHEN hi > lo THEN (score - lo) / (hi - lo) WHEN hi > 0 THEN 1 ELSE score END, 6) AS score FROM b""")
def minmax(t):
    return ranking.minmax(hits(t)).select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query("topk_cap", f"WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM hits) SELECT query_id, memory_id, score FROM r WHERE rn <= 10")
def topk_cap(t):
    return ranking.topk_cap(hits(t), 10).select("query_id", "memory_id", "score")


@query("merge_legs", f"WITH {HITS}, one AS (SELECT query_id, leg, memory_id // 2 AS memory_id, score FROM hits) SELECT query_id, memory_id, round(sum(score), 6) AS score FROM one GROUP BY query_id, memory_id")
def merge_legs(t):
    from ..plans.retrieval import merge_legs as merge
    one = hits(t).withColumn("memory_id", F.floor(F.col("memory_id") / 2).cast("bigint"))
    return merge(one.filter("leg = 'vector'"), one.filter("leg = 'text'")).withColumn("score", F.round("score", 6))


@query("recent_recalls", "SELECT tenant_id, session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, session_id ORDER BY ts DESC, event_id) AS rn FROM recall_events) WHERE rn <= 3")
def recent_recalls(t):
    return ranking.recent_recalls(t.recall_events, 3).select("tenant_id", "session_id", "event_id")


@query("select_recent", """WITH n AS (SELECT conv_id, turn, content, row_number() OVER w AS rn, sum(strlen(content)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used
  FROM session_messages WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
SELECT conv_id, turn FROM n WHERE rn <= 4 AND (used <= 1500 OR rn = 1)""")
def select_recent(t):
    return ranking.select_recent(t.session_messages, 4, 1500).select("conv_id", "turn")


@query("pack_budget", """WITH n AS (SELECT *, sum(strlen(concat('· ', slot, ' — ', value)) + 1) OVER (PARTITION BY tenant_id ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM preferences)
SELECT tenant_id, id, slot FROM n WHERE used <= 3000""")
def pack_budget(t):
    return ranking.pack_budget(t.preferences, ["tenant_id"]).select("tenant_id", "id", "slot")


@query("two_phase_recall", f"""WITH {HITS},
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM hits WHERE leg = 'text'),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM hits),
p AS (SELECT query_id, memory_id, score, rank FROM v WHERE rank <= 3),
u AS (SELECT *, 1 AS phase FROM p WHERE query_id % 2 = 0 UNION ALL SELECT query_id, memory_id, score, rank, 2 FROM g WHERE rank <= 10),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, memory_id ORDER BY phase, rank) AS k FROM u) WHERE k = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, phase ORDER BY rank, memory_id) AS n, count(*) FILTER (phase = 1) OVER (PARTITION BY query_id) AS firsts FROM o)
SELECT query_id, memory_id, score, phase, row_number() OVER (PARTITION BY query_id ORDER BY phase, n) AS position FROM n WHERE phase = 1 OR n <= greatest(5 - firsts, 0)""")
def two_phase_recall(t):
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    everywhere = hits(t).select("query_id", "memory_id", "score", rank.alias("rank")).filter("rank <= 10")
    project = hits(t).filter("leg = 'text'").select("query_id", "memory_id", "score", rank.alias("rank")).filter("rank <= 3")
    queries = hits(t).select("query_id").distinct().select(
        "query_id", F.lit(5).alias("max_results"), (F.col("query_id") % 2 == 0).alias("has_project_tags"))
    return ranking.two_phase_recall(project, everywhere, queries)


SECTIONED = """sectioned AS (SELECT id, session_id, scope, category, source, created_s, l0_abstract,
  CASE WHEN id % 3 = 0 THEN concat('## 2024-05-0', CAST(1 + id % 9 AS STRING), ' 10:00 topic ', CAST(id AS STRING), chr(10), content, chr(10), '## plain ', source_tag, chr(10)) ELSE content END AS content FROM memories)"""


def sectioned(t):
    headed = F.concat(F.lit("## 2024-05-0"), (1 + F.col("id") % 9).cast("string"), F.lit(" 10:00 topic "), F.col("id").cast("string"),
                      F.lit("\n"), "content", F.lit("\n## plain "), "source_tag", F.lit("\n"))
    return t.memory.withColumn("content", F.when(F.col("id") % 3 == 0, headed).otherwise(F.col("content")))


@query("merged_summary", f"""WITH {SECTIONED},
h AS (SELECT *, list_transform(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '## ')),
   lambda x: regexp_replace(x, '^## ([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}} )?', '')) AS topics FROM sectioned),
l AS (SELECT *, concat('[', strftime(make_timestamp(created_s * 1000000), '%Y-%m-%d %H:%M:%S'), '] ',
   CASE WHEN len(topics) = 0 THEN concat(l0_abstract, ': ', l0_abstract) ELSE array_to_string(topics, ' | ') END) AS line FROM h),
r AS (SELECT *, sum(strlen(line) + 2) OVER (PARTITION BY session_id ORDER BY created_s DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM l)
SELECT session_id, string_agg(line, chr(10) || chr(10) ORDER BY created_s DESC, id) AS summary FROM r WHERE used <= 2000 GROUP BY session_id""")
def merged_summary(t):
    return ranking.merged_summary(sectioned(t).withColumn("l1_overview", F.col("l0_abstract")), ["session_id"])


@query("recent_session_work", """WITH r AS (SELECT session_id, id, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, id) AS rn
 FROM memories WHERE scope <> 'private' AND category <> 'preferences' AND source = 'session_ingest') SELECT session_id, id, total FROM r WHERE rn <= 2""")
def recent_session_work(t):
    return ranking.recent_session_memories(t.memory, "work", 2).select("session_id", "id", "total")


@query("recent_session_private", """WITH r AS (SELECT session_id, id, count(*) OVER (PARTITION BY session_id) AS total, row_number() OVER (PARTITION BY session_id ORDER BY created_s DESC, id) AS rn
 FROM memories WHERE scope = 'private') SELECT session_id, id, total FROM r WHERE rn <= 5""")
def recent_session_private(t):
    return ranking.recent_session_memories(t.memory, "private").select("session_id", "id", "total")
