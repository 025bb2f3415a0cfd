from pyspark.sql import functions as F

from ..operators import catalog, graph, reconcile
from .registry import query
from .texts import norm_sql

ACCESS = """owned AS (SELECT owner_id AS user_id, space_id, 'owner' AS role FROM spaces UNION ALL SELECT user_id, space_id, role FROM space_members),
access AS (SELECT user_id, space_id, space_type, role, CASE space_type WHEN 'personal' THEN 1.0::DOUBLE WHEN 'team' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS weight,
  CASE WHEN role IN ('owner', 'admin', 'member') THEN 'rw' ELSE 'ro' END AS access FROM (SELECT *, row_number() OVER (PARTITION BY user_id, space_id
  ORDER BY CASE role WHEN 'owner' THEN 0 WHEN 'admin' THEN 1 WHEN 'member' THEN 2 ELSE 3 END) AS rn FROM owned) JOIN spaces USING (space_id) WHERE rn = 1)"""


@query("accessible_spaces", f"WITH {ACCESS}, n AS (SELECT tenant_id AS user_id, count(*) AS memories FROM memories GROUP BY 1) SELECT user_id, space_id, space_type, role, weight, access, memories FROM access JOIN n USING (user_id)")
def accessible_spaces(t):
    counts = t.memory.groupBy(F.col("tenant_id").alias("user_id")).agg(F.count("*").alias("memories"))
    return graph.accessible_spaces(t.spaces, t.space_members).join(counts, "user_id")


@query("write_access", f"WITH {ACCESS} SELECT DISTINCT s.user_id, s.to_space AS space_id, coalesce(a.access = 'rw', FALSE) AS can_write FROM sharing_events s LEFT JOIN access a ON a.user_id = s.user_id AND a.space_id = s.to_space")
def write_access(t):
    requests = t.sharing_events.select("user_id", F.col("to_space").alias("space_id")).distinct()
    return graph.write_access(requests, t.spaces, t.space_members)


@query("find_copies", "SELECT id, shared_from_memory FROM memories WHERE shared_from_memory IN (SELECT memory_id FROM sharing_events WHERE action = 'unshare')")
def find_copies(t):
    ids = t.sharing_events.filter("action = 'unshare'").select(F.col("memory_id").alias("id"))
    return graph.find_copies(t.memory, ids).select("id", "shared_from_memory")


@query("stale_copies", """WITH gone AS (SELECT doc_id AS id FROM labels WHERE toxic = 1), src AS (SELECT id, version FROM memories WHERE id NOT IN (SELECT id FROM gone))
SELECT m.id, m.shared_from_memory, m.source_version, s.version AS source_now, CASE WHEN m.shared_from_memory IS NOT NULL THEN s.id IS NULL OR m.source_version < s.version END AS is_stale,
 CASE WHEN m.shared_from_memory IS NOT NULL THEN s.id IS NULL END AS source_deleted FROM memories m LEFT JOIN src s ON s.id = m.shared_from_memory""")
def stale_copies(t):
    gone = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return graph.stale_copies(t.memory, t.memory.join(gone, "id", "left_anti"))


@query("events_with_items", """SELECT e.event_id, e.session_id, count(i.item_id) AS n_items, coalesce(string_agg(i.memory_id::VARCHAR, ',' ORDER BY i.item_id), '') AS memory_ids
 FROM recall_events e LEFT JOIN recall_items i USING (event_id) GROUP BY 1, 2""")
def events_with_items(t):
    return graph.events_with_items(t.recall_events, t.recall_items).select(
        "event_id", "session_id", F.size("items").cast("bigint").alias("n_items"),
        F.array_join(F.transform("items", lambda i: i["memory_id"].cast("string")), ",").alias("memory_ids"))


@query("cascade_delete_events", "SELECT event_id FROM recall_events WHERE session_id NOT IN (SELECT session_id FROM memories)")
def cascade_events(t):
    return graph.cascade_delete(t.recall_events, t.recall_items, t.memory)[0].select("event_id")


@query("cascade_delete_items", "SELECT item_id FROM recall_items WHERE event_id NOT IN (SELECT event_id FROM recall_events WHERE session_id IN (SELECT session_id FROM memories))")
def cascade_items(t):
    return graph.cascade_delete(t.recall_events, t.recall_items, t.memory)[1].select("item_id")


@query("minus_existing", "SELECT id, to_space FROM sharing_events WHERE (memory_id) NOT IN (SELECT shared_from_memory FROM memories WHERE shared_from_memory IS NOT NULL)")
def minus_existing(t):
    copies = t.memory.filter("shared_from_memory IS NOT NULL").select(F.col("shared_from_memory").alias("memory_id"))
    return graph.minus_existing(t.sharing_events, copies, ["memory_id"]).select("id", "to_space")


@query("dedup_messages", """WITH h AS (SELECT conv_id, turn, role, sha256(concat(session_id, role, content)) AS content_hash FROM session_messages)
SELECT conv_id, turn, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE role = 'system')""")
def dedup_messages(t):
    stored = graph.with_hash(t.session_messages.filter("role = 'system'"))
    return graph.dedup_messages(t.session_messages, stored).select("conv_id", "turn", "content_hash")


@query("dedup_messages_within", "SELECT DISTINCT sha256(concat(session_id, role, content)) AS content_hash FROM (SELECT * FROM session_messages UNION ALL SELECT * FROM session_messages)")
def dedup_within(t):
    twice = t.session_messages.unionByName(t.session_messages)
    none = graph.with_hash(t.session_messages).filter("role = 'nobody'")
    return graph.dedup_messages(twice, none, within_batch=True).select("content_hash")


PAIRS = "pairs AS (SELECT DISTINCT user_id AS user_a, 'tenant-' || (hash_id % 3) AS user_b FROM (SELECT user_id, memory_id % 3 AS hash_id FROM sharing_events))"


@query("bridge_space", f"""WITH {PAIRS}, {ACCESS}, f AS (SELECT user_a, user_b, min(a.space_id) AS found FROM pairs JOIN access a ON a.user_id = user_a AND a.space_type = 'team'
  JOIN access b ON b.user_id = user_b AND b.space_id = a.space_id GROUP BY 1, 2)
SELECT user_a, user_b, coalesce(found, concat('team/', left(sha256(user_a || '|' || user_b), 32))) AS space_id, found IS NULL AS is_new FROM pairs LEFT JOIN f USING (user_a, user_b)""")
def bridge_space(t):
    return graph.bridge_space(user_pairs(t), t.spaces, t.space_members)


def user_pairs(t):
    return t.sharing_events.select(
        F.col("user_id").alias("user_a"), F.concat(F.lit("tenant-"), (F.col("memory_id") % 3).cast("string")).alias("user_b"))


CATEGORIES = """names(name, aw, ib) AS (VALUES ('preferences', 0.90, 0.70), ('identity', 0.75, 0.80), ('emotional', 0.65, 0.55), ('project', 0.70, 0.60), ('work', 0.55, 0.45),
 ('lessons_learned', 0.85, 0.70), ('decisions', 0.80, 0.75), ('success_patterns', 0.85, 0.65), ('mistakes', 0.80, 0.60))"""


def categories(t):
    return catalog.seed_categories(t.memory.select("tenant_id"))


def aliases(t):
    return catalog.seed_aliases(t.memory.select("tenant_id"))


@query("seed_categories", f"WITH {CATEGORIES} SELECT tenant_id, name, aw::DOUBLE AS admission_weight, ib::DOUBLE AS importance_base FROM (SELECT DISTINCT tenant_id FROM memories) t JOIN names ON TRUE")
def seed_categories(t):
    kept = categories(t).filter("name IN ('work', 'project')")
    return catalog.seed_categories(t.memory.select("tenant_id"), kept).select("tenant_id", "name", "admission_weight", "importance_base")


@query("seed_aliases", "SELECT tenant_id, count(*) AS n FROM (SELECT DISTINCT tenant_id FROM memories) t, unnest(range(19)) GROUP BY tenant_id")
def seed_aliases(t):
    kept = aliases(t).filter("target = 'work'")
    return catalog.seed_aliases(t.memory.select("tenant_id"), kept).groupBy("tenant_id").agg(F.count("*").alias("n"))


RESOLVED = """resolved AS (SELECT * REPLACE (CASE lower(trim(category)) WHEN 'likes' THEN 'preferences' ELSE lower(trim(category)) END AS category) FROM facts)"""


@query("resolve_category", f"WITH {RESOLVED} SELECT fact_id, category FROM resolved")
def resolve_category(t):
    return graph.resolve_category(t.facts, categories(t), aliases(t)).select("fact_id", "category")


@query("resolve_category_fallback", f"WITH {CATEGORIES} SELECT fact_id, lower(trim(category)) AS category FROM facts WHERE lower(trim(category)) IN (SELECT name FROM names)")
def resolve_fallback(t):
    return graph.resolve_category(t.facts, None, None).select("fact_id", "category")


@query("category_weights", f"WITH {RESOLVED}, {CATEGORIES} SELECT fact_id, coalesce(aw, 0.5)::DOUBLE AS admission_weight, coalesce(ib, 0.5)::DOUBLE AS importance_base FROM resolved LEFT JOIN names ON name = category")
def category_weights(t):
    resolved = graph.resolve_category(t.facts, categories(t), aliases(t))
    return graph.category_weights(resolved, categories(t)).select("fact_id", "admission_weight", "importance_base")


@query("relation_graph", """WITH k AS (SELECT * FROM memories WHERE importance >= 0.2)
SELECT src_id AS source, target_id AS target, relation_type, coalesce(a.space_id <> '' AND b.space_id <> '' AND a.space_id <> b.space_id, FALSE) AS cross_space FROM memory_relations JOIN k a ON a.id = src_id LEFT JOIN k b ON b.id = target_id
UNION ALL SELECT superseded_by, id, 'supersedes', FALSE FROM k WHERE superseded_by IS NOT NULL
UNION ALL SELECT shared_from_memory, id, 'shared_from', space_id <> 'team/t1' FROM k WHERE shared_from_memory IS NOT NULL""")
def relation_graph(t):
    return edges_of(t)


def edges_of(t):
    memories = t.memory.withColumn("shared_from_space", F.lit("team/t1"))
    return graph.relation_graph(memories, t.memory_relations, 0.2)


@query("graph_nodes", """WITH k AS (SELECT * FROM memories WHERE importance >= 0.2), e AS (SELECT src_id AS a, target_id AS b FROM memory_relations WHERE src_id IN (SELECT id FROM k)
 UNION ALL SELECT superseded_by, id FROM k WHERE superseded_by IS NOT NULL UNION ALL SELECT shared_from_memory, id FROM k WHERE shared_from_memory IS NOT NULL)
SELECT id, tier FROM k WHERE id IN (SELECT a FROM e UNION SELECT b FROM e)""")
def graph_nodes(t):
    return graph.graph_nodes(t.memory, edges_of(t), 0.2).select("id", "tier")


@query("chain_tail", """WITH RECURSIVE nxt AS (SELECT src_id, min(target_id) AS target_id FROM memory_relations WHERE relation_type = 'continued_by' GROUP BY 1),
walk AS (SELECT id, id AS place FROM memories UNION ALL SELECT walk.id, target_id FROM walk JOIN nxt ON src_id = place)
SELECT id, max(place) AS tail_id FROM walk GROUP BY id""")
def chain_tail(t):
    return graph.chain_tail(t.memory, t.memory_relations)


@query("chain_members", """WITH RECURSIVE l AS (SELECT src_id, target_id FROM memory_relations WHERE relation_type IN ('continues', 'continued_by')),
walk AS (SELECT id AS root_id, id, 0 AS depth FROM memories UNION SELECT root_id, target_id, depth + 1 FROM walk JOIN l ON src_id = walk.id WHERE depth < 5)
SELECT root_id, id, min(depth)::INT AS depth FROM walk GROUP BY 1, 2""")
def chain_members(t):
    return graph.chain_members(t.memory.select(F.col("id").alias("root_id")), t.memory_relations, t.memory)


GROUPS = """grp AS (SELECT doc_id AS id, concat(lang, '/', CAST(doc_id % 150 AS STRING)) AS group_id FROM documents UNION ALL SELECT doc_id + 990, concat(lang, '/x') FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
shape AS (SELECT group_id, count(*) AS n, count(m.id) AS hits, count(DISTINCT tenant_id) AS tenants FROM grp LEFT JOIN memories m USING (id) GROUP BY 1),
judged AS (SELECT group_id, n, CASE WHEN n NOT BETWEEN 2 AND 10 THEN 'size' WHEN hits < n THEN 'not_found' WHEN tenants > 1 THEN 'tenant' END AS reason FROM shape)"""


def merge_input(t):
    groups = t.documents.select(F.col("doc_id").alias("id"), F.concat("lang", F.lit("/"), (F.col("doc_id") % 150).cast("string")).alias("group_id"))
    bad = t.documents.join(t.labels.filter("toxic = 1"), "doc_id").select((F.col("doc_id") + 990).alias("id"), F.concat("lang", F.lit("/x")).alias("group_id"))
    groups = groups.unionByName(bad)
    contents = groups.select("group_id").distinct().withColumn("merged_content", F.repeat(F.concat("group_id", F.lit(" ")), 40))
    return graph.merge_groups(t.memory, groups, contents)


@query("merge_groups", f"""WITH {GROUPS}, r AS (SELECT group_id, m.*, row_number() OVER (PARTITION BY group_id ORDER BY confidence DESC, importance DESC, id DESC) AS rn FROM grp JOIN judged USING (group_id) JOIN memories m USING (id) WHERE reason IS NULL),
tg AS (SELECT group_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM grp JOIN memory_tags USING (id) GROUP BY 1), c AS (SELECT *, repeat(group_id || ' ', 40) AS merged FROM r WHERE rn = 1)
SELECT group_id, id, left(merged, 100) AS l0_abstract, CASE WHEN length(merged) > 200 THEN left(merged, 200) || '...' ELSE merged END AS l1_overview, tags FROM c JOIN tg USING (group_id)""")
def merge_groups(t):
    return merge_input(t)[0].select("group_id", "id", "l0_abstract", "l1_overview", F.array_join("tags", "|").alias("tags"))


@query("merge_groups_consumed", f"WITH {GROUPS} SELECT group_id, id FROM (SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY confidence DESC, importance DESC, id DESC) AS rn FROM grp JOIN judged USING (group_id) JOIN memories m USING (id) WHERE reason IS NULL) WHERE rn > 1")
def merge_consumed(t):
    return merge_input(t)[1]


@query("merge_groups_refused", f"WITH {GROUPS} SELECT group_id, n, reason FROM judged WHERE reason IS NOT NULL")
def merge_refused(t):
    return merge_input(t)[2]


def trigram_rows(source, columns):
    """Distinct trigrams of normalised abstracts; an empty set has the one token ''."""
    return f"""(SELECT {columns}, unnest(CASE WHEN length(s) < 3 THEN [''] ELSE list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) END) AS g
  FROM (SELECT *, {norm_sql('l0_abstract')} AS s FROM {source}))"""


FUZZY = f"""ft AS {trigram_rows('facts', 'fact_id, tenant_id')}, mt AS {trigram_rows('memories', 'id, tenant_id')},
fn AS (SELECT fact_id, count(*) AS n FROM ft GROUP BY 1), mn AS (SELECT id, count(*) AS n FROM mt GROUP BY 1),
sim AS (SELECT ft.tenant_id, fact_id, id, count(*) / (any_value(fn.n) + any_value(mn.n) - count(*))::DOUBLE AS similarity FROM ft JOIN mt USING (tenant_id, g) JOIN fn USING (fact_id) JOIN mn USING (id) GROUP BY 1, 2, 3)"""


@query("fuzzy_join", f"WITH {FUZZY} SELECT tenant_id, fact_id, id AS memory_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY similarity DESC, id) AS rn FROM sim WHERE similarity > 0.4) WHERE rn = 1")
def fuzzy_join(t):
    return reconcile.fuzzy_join(t.facts, t.memory, 0.4).withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_pairs", f"""WITH f AS {trigram_rows('facts', 'batch_id, fact_index')}, n AS (SELECT batch_id, fact_index, count(*) AS n FROM f GROUP BY 1, 2)
SELECT a.batch_id, a.fact_index AS a, b.fact_index AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE, 6) AS similarity FROM f a JOIN f b ON a.batch_id = b.batch_id AND a.g = b.g AND a.fact_index < b.fact_index
 JOIN n x ON x.batch_id = a.batch_id AND x.fact_index = a.fact_index JOIN n y ON y.batch_id = b.batch_id AND y.fact_index = b.fact_index GROUP BY 1, 2, 3 HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE > 0.2""")
def fuzzy_pairs(t):
    return reconcile.fuzzy_pairs(t.facts, 0.2).withColumn("similarity", F.round("similarity", 6))
