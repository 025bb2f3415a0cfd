from pyspark.sql import functions as F

from ..operators import graph, vectors
from ..operators.text_search import text_topk
from ..plans import retrieval
from .lifecycle import decay_sql
from .registry import query
from .views import AS_OF


def with_vectors(t):
    """Queries with embedding, access keys and tags."""
    named = t.memory_queries.join(t.embeddings.select(F.col("vec_id").alias("query_vec_id"), "embedding"), "query_vec_id")
    access = retrieval.query_access(named, graph.accessible_spaces(t.spaces, t.space_members))
    return access.withColumn("tags", F.array_compact(F.array("query_tag")))


def rows(t):
    return t.memory_vectors.withColumnRenamed("id", "memory_id")


SIMILAR = "least(1, greatest(-1, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
# every query against every distinct vector, then the memories that carry it
VECTOR_SCORES = f"""scored_vectors AS (SELECT query_id, e.vec_id, round({SIMILAR}, 6) AS score
  FROM memory_queries mq JOIN embeddings q ON q.vec_id = mq.query_vec_id CROSS JOIN vectors e)"""


@query("vector_topk", f"""WITH {VECTOR_SCORES}, r AS (SELECT query_id, id AS memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn
  FROM scored_vectors JOIN memories USING (vec_id)) SELECT query_id, memory_id, score FROM r WHERE rn <= 20 AND score >= 0.1""")
def vector_topk(t):
    return vectors.vector_topk(with_vectors(t).select("query_id", "embedding"), rows(t), 20, 0.1)


@query("vector_topk_blocks", f"""WITH {VECTOR_SCORES}, r AS (SELECT query_id, id AS memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn
  FROM scored_vectors JOIN memories USING (vec_id)) SELECT query_id, memory_id, score FROM r WHERE rn <= 20""")
def vector_topk_blocks(t):
    return vectors.vector_topk(with_vectors(t).select("query_id", "embedding"), rows(t), 20, query_bound=16, cell_rows=300)


OPEN = """((m.visibility = 'global' AND m.tenant_id = mq.tenant_id)
   OR (m.visibility = 'private' AND m.owner_agent_id = mq.agent_id AND m.tenant_id = mq.tenant_id)
   OR (m.visibility = 'shared:team/t1' AND mq.tenant_id IN ('tenant-0', 'tenant-1')))"""
ALLOWED = OPEN + """
  AND (mq.project_path IS NULL OR m.project_path IS NULL OR m.project_path = mq.project_path OR starts_with(m.project_path, mq.project_path || '/')
   OR starts_with(mq.project_path, m.project_path || '/') OR m.visibility = 'private')"""
VECTOR_LEG = f"""{VECTOR_SCORES},
vector_hits AS (SELECT * FROM (SELECT query_id, m.id AS memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, m.id) AS rank
  FROM scored_vectors s JOIN memories m USING (vec_id) JOIN memory_queries mq USING (query_id) WHERE {ALLOWED}) WHERE rank <= 60 AND score >= 0)"""


@query("vector_leg", f"WITH {VECTOR_LEG} SELECT query_id, memory_id, score, rank FROM vector_hits")
def vector_leg(t):
    return retrieval.vector_leg(with_vectors(t), t.memory, t.memory_vectors, 60).withColumn("rank", F.col("rank").cast("bigint"))


STORE = "CASE WHEN starts_with(visibility, 'shared:') THEN visibility ELSE tenant_id END"
# Grams come from windows over the characters of whole texts; counts are those of a text's store.
TEXT_SCORES = """chars AS (SELECT id, 0 AS field, unnest(string_split(lower(content), '')) AS c, unnest(range(length(content))) AS i FROM memories
  UNION ALL SELECT id, 1, unnest(string_split(lower(l0_abstract), '')), unnest(range(length(l0_abstract))) FROM memories),
doc_grams AS (SELECT id, field, unnest([a || b, a || b || c, a || b || c || d]) AS gram FROM (SELECT id, field, c AS a, lead(c, 1) OVER w AS b, lead(c, 2) OVER w AS c, lead(c, 3) OVER w AS d
  FROM chars WINDOW w AS (PARTITION BY id, field ORDER BY i))),
query_grams AS (SELECT DISTINCT query_id, unnest(list_concat(list_transform(range(1, length(query_text)), lambda i: substr(lower(query_text), i, 2)),
  list_transform(range(1, length(query_text) - 1), lambda i: substr(lower(query_text), i, 3)), list_transform(range(1, length(query_text) - 2), lambda i: substr(lower(query_text), i, 4)))) AS gram FROM memory_queries),
sizes AS (SELECT id, 0 AS field, (greatest(length(content) - 1, 0) + greatest(length(content) - 2, 0) + greatest(length(content) - 3, 0))::DOUBLE AS size FROM memories
  UNION ALL SELECT id, 1, (greatest(length(l0_abstract) - 1, 0) + greatest(length(l0_abstract) - 2, 0) + greatest(length(l0_abstract) - 3, 0))::DOUBLE FROM memories),
owners AS (SELECT id, STORE AS store FROM memories),
field_stats AS (SELECT store, field, count(*) AS n, avg(size) AS avg_size FROM sizes JOIN owners USING (id) GROUP BY store, field),
tf AS (SELECT id, field, gram, count(*) AS tf FROM doc_grams WHERE gram IN (SELECT gram FROM query_grams) GROUP BY 1, 2, 3),
df AS (SELECT store, field, gram, count(*) AS df FROM tf JOIN owners USING (id) GROUP BY 1, 2, 3),
parts AS (SELECT tf.id, tf.field, tf.gram, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / avg_size)) AS part
  FROM tf JOIN owners USING (id) JOIN df USING (store, field, gram) JOIN field_stats USING (store, field) JOIN sizes USING (id, field)),
by_field AS (SELECT query_id, id, field, sum(part) AS score FROM parts JOIN query_grams USING (gram) GROUP BY 1, 2, 3)"""
TEXT_TOP = TEXT_SCORES.replace("STORE", "''") + """,
text_top AS (SELECT * FROM (SELECT query_id, id AS memory_id, round(max(score), 6) AS text_score, row_number() OVER (PARTITION BY query_id ORDER BY round(max(score), 6) DESC, id) AS rn FROM by_field GROUP BY query_id, id) WHERE rn <= 60)"""


@query("text_topk", f"WITH {TEXT_TOP} SELECT query_id, memory_id, text_score FROM text_top")
def text_top(t):
    return text_topk(t.memory_queries.select("query_id", "query_text"), t.memory, 60)


@query("text_topk_blocks", f"WITH {TEXT_TOP} SELECT query_id, memory_id, text_score FROM text_top WHERE rn <= 10")
def text_top_blocks(t):
    return text_topk(t.memory_queries.select("query_id", "query_text"), t.memory, 10, query_bound=16)


TEXT_LEG = f"""{TEXT_SCORES.replace("STORE", STORE)},
text_hits AS (SELECT query_id, memory_id, least(score, 1) AS text_score, rank FROM (
  SELECT query_id, h.id AS memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.id) AS rank
  FROM (SELECT query_id, id, round(max(score), 6) AS score FROM by_field GROUP BY query_id, id) h
  JOIN memories m ON m.id = h.id JOIN memory_queries mq USING (query_id) WHERE {ALLOWED}) WHERE rank <= 60)"""


@query("text_leg", f"WITH {TEXT_LEG} SELECT query_id, memory_id, text_score, rank FROM text_hits")
def text_leg(t):
    return retrieval.text_leg(with_vectors(t), t.memory, 60).withColumn("rank", F.col("rank").cast("bigint"))


IN_SCOPE = ALLOWED + """ AND (mq.query_id % 3 <> 0 OR m.scope = 'global')
  AND CASE mq.query_id % 5 WHEN 0 THEN m.project_path IS NULL WHEN 1 THEN m.project_path <> '' ELSE TRUE END"""


def scoped(t):
    kind = F.col("query_id") % 5
    return with_vectors(t).withColumns({
        "scope": F.when(F.col("query_id") % 3 == 0, "global"), "global_scope": F.when(kind == 0, "only").when(kind == 1, "exclude")})


@query("vector_leg_scopes", f"WITH {VECTOR_LEG.replace(ALLOWED, IN_SCOPE)} SELECT query_id, memory_id, score, rank FROM vector_hits")
def vector_leg_scopes(t):
    return retrieval.vector_leg(scoped(t), t.memory, t.memory_vectors, 60).withColumn("rank", F.col("rank").cast("bigint"))


@query("text_leg_scopes", f"WITH {TEXT_LEG.replace(ALLOWED, IN_SCOPE)} SELECT query_id, memory_id, text_score, rank FROM text_hits")
def text_leg_scopes(t):
    return retrieval.text_leg(scoped(t), t.memory, 60).withColumn("rank", F.col("rank").cast("bigint"))


# Stages are checked on cheap hits: kept recall items are the vector leg, the others the text leg.
CHEAP = """raw_hits AS (SELECT query_id, memory_id, leg, max(score) AS score FROM (SELECT event_id % 40 AS query_id, memory_id, CASE WHEN is_kept THEN 'vector' ELSE 'text' END AS leg, score FROM recall_items) GROUP BY 1, 2, 3),
legs AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg ORDER BY score DESC, memory_id) AS rank FROM raw_hits),
vector_hits AS (SELECT query_id, memory_id, score, rank FROM legs WHERE leg = 'vector'),
text_hits AS (SELECT query_id, memory_id, score AS text_score, rank FROM legs WHERE leg = 'text')"""
TAG_LEG = """tag_hits AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, memory_id) AS rank
  FROM (SELECT query_id, memory_id FROM vector_hits UNION SELECT query_id, memory_id FROM text_hits) c JOIN memory_queries USING (query_id) JOIN memory_tags g ON g.id = memory_id AND g.tag = query_tag GROUP BY query_id, memory_id)"""
FUSED = """fused AS (SELECT query_id, memory_id, sum(part) * any_value(CASE WHEN memory_type = 'pinned' THEN 1.5::DOUBLE ELSE 1 END) AS score, max(text_score) AS text_score FROM (
   SELECT query_id, memory_id, (0.7::DOUBLE / 1.2::DOUBLE) / (60 + rank) AS part, 0::DOUBLE AS text_score FROM vector_hits
   UNION ALL SELECT query_id, memory_id, (0.3::DOUBLE / 1.2::DOUBLE) / (60 + rank), text_score FROM text_hits
   UNION ALL SELECT query_id, memory_id, (0.2::DOUBLE / 1.2::DOUBLE) / (60 + rank), 0 FROM tag_hits) JOIN memories ON id = memory_id GROUP BY 1, 2)"""
NORMAL = """normal AS (SELECT query_id, memory_id, text_score, CASE WHEN n = 1 THEN least(1, 120 * score) WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END AS score
   FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM fused WINDOW w AS (PARTITION BY query_id)))"""
CAPPED = """capped AS (SELECT query_id, memory_id, score, text_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM normal WHERE score >= 0.15) WHERE rn <= 40)"""
EXPANDED = f"""targets AS (SELECT DISTINCT query_id, target_id AS memory_id FROM capped JOIN memory_relations ON src_id = memory_id),
added AS (SELECT query_id, memory_id, (SELECT min(score) * 0.8::DOUBLE FROM capped c WHERE c.query_id = a.query_id) AS score, 0::DOUBLE AS text_score FROM
   (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY memory_id) AS rn FROM targets t JOIN memories m ON m.id = memory_id JOIN memory_queries mq USING (query_id)
     WHERE {OPEN} AND NOT EXISTS (SELECT 1 FROM capped c WHERE c.query_id = t.query_id AND c.memory_id = t.memory_id)) a WHERE rn <= 20),
expanded AS (SELECT query_id, memory_id, score, text_score FROM capped UNION ALL SELECT * FROM added)"""
BASE = f"{CHEAP}, {TAG_LEG}, {FUSED}, {NORMAL}, {CAPPED}, {EXPANDED}"


def cheap_legs(t):
    from ..operators.ranking import rank_leg
    hits = t.recall_items.select(
        (F.col("event_id") % 40).alias("query_id"), "memory_id", F.when(F.col("is_kept"), "vector").otherwise("text").alias("leg"), "score"
    ).groupBy("query_id", "memory_id", "leg").agg(F.max("score").alias("score"))
    ranked = rank_leg(hits)
    return (ranked.filter("leg = 'vector'").drop("leg"),
            ranked.filter("leg = 'text'").drop("leg").withColumnRenamed("score", "text_score"))


def cheap_tags(t):
    vector, text = cheap_legs(t)
    both = vector.select("query_id", "memory_id").unionByName(text.select("query_id", "memory_id"))
    return retrieval.tag_leg(both, with_vectors(t), t.memory)


def cheap_fused(t):
    vector, text = cheap_legs(t)
    return retrieval.rrf_fuse(vector, text, cheap_tags(t), t.memory)


def cheap_capped(t):
    from ..operators import ranking
    return ranking.topk_cap(retrieval.min_score_filter(ranking.minmax(cheap_fused(t)), 0.15), 40)


def rounded(df, *names):
    return df.select("query_id", "memory_id", *[F.round(n, 6).alias(n) for n in names])


@query("tag_leg", f"WITH {CHEAP}, {TAG_LEG} SELECT query_id, memory_id, rank FROM tag_hits")
def tag_leg(t):
    return cheap_tags(t).withColumn("rank", F.col("rank").cast("bigint"))


@query("rrf_fuse", f"WITH {BASE} SELECT query_id, memory_id, round(score, 6) AS score, round(text_score, 6) AS text_score FROM fused")
def rrf_fuse(t):
    return rounded(cheap_fused(t), "score", "text_score")


@query("rrf_normalize", f"WITH {BASE} SELECT query_id, memory_id, round(score, 6) AS score FROM normal")
def rrf_normalize(t):
    from ..operators import ranking
    return rounded(ranking.minmax(cheap_fused(t)), "score")


@query("min_score_filter", f"WITH {BASE} SELECT query_id, memory_id, round(score, 6) AS score FROM normal WHERE score >= 0.15")
def min_score_filter(t):
    from ..operators import ranking
    return rounded(retrieval.min_score_filter(ranking.minmax(cheap_fused(t)), 0.15), "score")


@query("expand_relations", f"WITH {BASE} SELECT query_id, memory_id, round(score, 6) AS score FROM expanded")
def expand_relations(t):
    return rounded(retrieval.expand(cheap_capped(t), t.memory_relations, t.memory, with_vectors(t)), "score")


RERANK = """reranked AS (SELECT query_id, memory_id, ((query_id * 31 + memory_id * 17) % 100) / 100.0::DOUBLE AS rerank_score FROM expanded WHERE (query_id + memory_id) % 4 <> 0),
blended AS (SELECT query_id, memory_id, text_score, e.score AS pre_score, coalesce(rerank_score, 0) * 0.6::DOUBLE + e.score * (1.0::DOUBLE - 0.6::DOUBLE) AS score FROM expanded e LEFT JOIN reranked USING (query_id, memory_id)),
floored AS (SELECT * REPLACE (CASE WHEN text_score >= 0.75 THEN greatest(score, pre_score * 0.95::DOUBLE) ELSE score END AS score) FROM blended)"""


def cheap_blended(t):
    expanded = retrieval.expand(cheap_capped(t), t.memory_relations, t.memory, with_vectors(t))
    answers = expanded.filter("(query_id + memory_id) % 4 <> 0").select(
        "query_id", "memory_id", (((F.col("query_id") * 31 + F.col("memory_id") * 17) % 100) / 100.0).alias("rerank_score"))
    return retrieval.blend_rerank(expanded, answers)


@query("blend_rerank", f"WITH {BASE}, {RERANK} SELECT query_id, memory_id, round(score, 6) AS score, round(pre_score, 6) AS pre_score FROM blended")
def blend_rerank(t):
    return rounded(cheap_blended(t), "score", "pre_score")


@query("bm25_floor", f"WITH {BASE}, {RERANK} SELECT query_id, memory_id, round(score, 6) AS score FROM floored")
def bm25_floor(t):
    return rounded(retrieval.text_floor(cheap_blended(t)), "score")


def with_rows(t, df):
    return df.join(t.memory.select(F.col("id").alias("memory_id"), *retrieval.ATTRIBUTES), "memory_id")


@query("decay_boost", f"WITH {CHEAP}, {decay_sql()} SELECT query_id, memory_id, round(v.score * (0.3::DOUBLE + 0.7::DOUBLE * strength), 6) AS score FROM vector_hits v JOIN scored ON id = memory_id")
def decay_boost(t):
    return rounded(retrieval.decay_boost(with_rows(t, cheap_legs(t)[0]), AS_OF), "score")


@query("importance_weight", f"WITH {CHEAP} SELECT query_id, memory_id, round(score * (0.7::DOUBLE + 0.3::DOUBLE * importance), 6) AS score FROM vector_hits JOIN memories ON id = memory_id")
def importance_weight(t):
    return rounded(retrieval.importance_weight(with_rows(t, cheap_legs(t)[0])), "score")


@query("length_normalize", f"""WITH {CHEAP}, s AS (SELECT query_id, memory_id, score, strlen(CASE WHEN l0_abstract = '' THEN content ELSE l0_abstract END) / 500.0::DOUBLE AS size FROM vector_hits JOIN memories ON id = memory_id)
SELECT query_id, memory_id, round(score / CASE WHEN size > 0 THEN greatest(1, 1 + log2(size)) ELSE 1 END, 6) AS score FROM s""")
def length_normalize(t):
    return rounded(retrieval.length_normalize(with_rows(t, cheap_legs(t)[0])), "score")


@query("hard_cutoff", f"WITH {CHEAP} SELECT query_id, memory_id, score FROM vector_hits WHERE score >= 0.005")
def hard_cutoff(t):
    return retrieval.min_score_filter(cheap_legs(t)[0], 0.005).select("query_id", "memory_id", "score")


CONTENT_SETS = """tokens AS (SELECT DISTINCT id, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS tok FROM memories),
sizes_of AS (SELECT id, count(*) AS n FROM tokens GROUP BY id),
alike AS (SELECT a.id AS x, b.id AS y FROM tokens a JOIN tokens b ON a.tok = b.tok AND a.id <> b.id JOIN sizes_of p ON p.id = a.id JOIN sizes_of q ON q.id = b.id
  WHERE q.n >= p.n * 0.85 AND p.n >= q.n * 0.85 GROUP BY a.id, b.id, p.n, q.n HAVING count(*) / (p.n + q.n - count(*))::DOUBLE > 0.85)"""


def diverse_sql(source, limit):
    return f"""places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS place FROM {source}),
halved AS (SELECT query_id, memory_id, score * CASE WHEN EXISTS (SELECT 1 FROM places b JOIN alike ON alike.x = b.memory_id AND alike.y = a.memory_id WHERE b.query_id = a.query_id AND b.place < a.place) THEN 0.5::DOUBLE ELSE 1 END AS score FROM places a),
diverse AS (SELECT query_id, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM halved) WHERE rn <= {limit})"""


@query("mmr_diversity", f"WITH {CHEAP}, {CONTENT_SETS}, {diverse_sql('vector_hits', 100)} SELECT query_id, memory_id, score FROM diverse")
def mmr_diversity(t):
    hits = cheap_legs(t)[0].drop("rank").join(t.memory.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    texts = t.memory.select(F.col("id").alias("memory_id"), "content")
    return retrieval.diversity(hits, retrieval.Settings(limit=100), texts).select("query_id", "memory_id", "score")


def verdict_sql(strategy):
    bad = "('irrelevant', 'medium')" if strategy == "strict" else "('irrelevant')"
    return f"""judged AS (SELECT v.query_id, v.memory_id, v.score, row_number() OVER (PARTITION BY v.query_id ORDER BY v.score DESC, v.memory_id) AS place,
  CASE (v.query_id + v.memory_id) % 5 WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'medium' WHEN 2 THEN NULL ELSE 'high' END AS relevance FROM vector_hits v),
kept AS (SELECT query_id, memory_id, CASE WHEN place <= 15 THEN relevance END AS relevance FROM judged WHERE place > 15 OR (relevance IS NOT NULL AND relevance NOT IN {bad})),
dropped AS (SELECT query_id, memory_id, relevance FROM judged WHERE place <= 15 AND relevance IN {bad})"""


def judged(t, strategy):
    hits = cheap_legs(t)[0].drop("rank")
    kind = (F.col("query_id") + F.col("memory_id")) % 5
    verdicts = hits.filter(kind != 2).select("query_id", "memory_id", F.when(kind == 0, "irrelevant").when(kind == 1, "medium").otherwise("high").alias("relevance"))
    return retrieval.apply_relevance(hits, verdicts, retrieval.Settings(strategy=strategy))


@query("apply_relevance", f"WITH {CHEAP}, {verdict_sql('balanced')} SELECT * FROM kept")
def apply_relevance(t):
    return judged(t, "balanced")[0].select("query_id", "memory_id", "relevance")


@query("apply_relevance_strict", f"WITH {CHEAP}, {verdict_sql('strict')} SELECT * FROM kept")
def apply_relevance_strict(t):
    return judged(t, "strict")[0].select("query_id", "memory_id", "relevance")


@query("apply_relevance_discarded", f"WITH {CHEAP}, {verdict_sql('strict')} SELECT * FROM dropped")
def apply_relevance_discarded(t):
    return judged(t, "strict")[1].select("query_id", "memory_id", "relevance")


def search_sql(tags=True):
    tag_part = TAG_LEG if tags else "tag_hits AS (SELECT query_id, memory_id, rank FROM vector_hits WHERE FALSE)"
    return f"""WITH {VECTOR_LEG}, {TEXT_LEG}, {tag_part}, {FUSED}, {NORMAL}, {CAPPED}, {EXPANDED},
weighed AS (WITH {decay_sql()} SELECT query_id, memory_id, x.score * (0.3::DOUBLE + 0.7::DOUBLE * strength) * (0.7::DOUBLE + 0.3::DOUBLE * importance)
   / CASE WHEN strlen(CASE WHEN l0_abstract = '' THEN content ELSE l0_abstract END) > 0 THEN greatest(1, 1 + log2(strlen(CASE WHEN l0_abstract = '' THEN content ELSE l0_abstract END) / 500.0::DOUBLE)) ELSE 1 END AS score
   FROM expanded x JOIN scored ON id = memory_id),
cutoff AS (SELECT * FROM weighed WHERE score >= 0.005), {CONTENT_SETS}, {diverse_sql('cutoff', 20)}"""


def run_search(t, **kwargs):
    return retrieval.search(with_vectors(t), t.memory, t.memory_vectors, t.memory_relations, AS_OF, **kwargs)


@query("search", search_sql() + " SELECT query_id, memory_id, round(score, 6) AS score FROM diverse")
def search(t):
    return rounded(run_search(t).results, "score")


SPACE_OPEN = """(m.space_id = mq.space_id AND (m.visibility = 'global' OR (m.visibility = 'private' AND m.owner_agent_id = mq.agent_id)
   OR (m.visibility = 'shared:team/t1' AND mq.tenant_id IN ('tenant-0', 'tenant-1'))))"""
SPACE_QUERIES = """opened AS (SELECT owner_id AS user_id, space_id FROM spaces UNION SELECT user_id, space_id FROM space_members),
space_queries AS (SELECT q.* REPLACE (concat(q.query_id, '#', space_id) AS query_id), q.query_id AS plain_id, space_id,
  CASE space_type WHEN 'personal' THEN 1.0::DOUBLE WHEN 'team' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS weight
  FROM memory_queries q JOIN opened ON user_id = tenant_id JOIN spaces USING (space_id))"""
SPACE_SEARCH = search_sql().replace(OPEN, SPACE_OPEN).replace("memory_queries", "space_queries").replace(f"{STORE} AS store", "space_id AS store")


@query("search_spaces", f"""WITH {SPACE_QUERIES}, {SPACE_SEARCH.removeprefix("WITH ")},
scaled AS (SELECT plain_id, s.space_id, memory_id, CASE WHEN best > 0 THEN score / best ELSE 0 END * weight AS score
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM diverse) JOIN space_queries s USING (query_id))
SELECT plain_id AS query_id, space_id, memory_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY plain_id ORDER BY score DESC, memory_id) AS rn FROM scaled) WHERE rn <= 20""")
def search_spaces(t):
    named = t.memory_queries.join(t.embeddings.select(F.col("vec_id").alias("query_vec_id"), "embedding"), "query_vec_id").withColumn(
        "tags", F.array_compact(F.array("query_tag")))
    hits = retrieval.search_spaces(named, t.memory, t.memory_vectors, t.memory_relations, graph.accessible_spaces(t.spaces, t.space_members), AS_OF)
    return hits.select("query_id", "space_id", "memory_id", F.round("score", 6).alias("score"))


@query("merge_spaces", f"""WITH {CHEAP}, a AS (SELECT owner_id AS user_id, space_id FROM spaces UNION SELECT user_id, space_id FROM space_members),
w AS (SELECT user_id, space_id, CASE space_type WHEN 'personal' THEN 1.0::DOUBLE WHEN 'team' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS weight FROM a JOIN spaces USING (space_id)),
p AS (SELECT query_id, memory_id, v.score, weight, max(v.score) OVER (PARTITION BY query_id, m.space_id) AS best FROM vector_hits v JOIN memory_queries mq USING (query_id)
   JOIN memories m ON m.id = memory_id JOIN w ON w.user_id = mq.tenant_id AND w.space_id = m.space_id),
r AS (SELECT *, CASE WHEN best > 0 THEN score / best ELSE 0 END * weight AS s FROM p)
SELECT query_id, memory_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS rn FROM r) WHERE rn <= 20""")
def merge_spaces(t):
    hits = cheap_legs(t)[0].join(t.memory_queries.select("query_id", F.col("tenant_id").alias("user_id")), "query_id")
    spaces = graph.accessible_spaces(t.spaces, t.space_members).select("user_id", "space_id", "weight")
    placed = hits.join(t.memory.select(F.col("id").alias("memory_id"), "space_id"), "memory_id").join(spaces, ["user_id", "space_id"])
    return rounded(retrieval.merge_spaces(placed, 20), "score")


@query("cross_reconcile", f"""WITH p AS (SELECT q.vec_id AS a, e.vec_id AS b, round({SIMILAR}, 6) AS score FROM vectors q JOIN vectors e ON TRUE),
c AS (SELECT x.id AS src_id, y.id AS target_id, score, row_number() OVER (PARTITION BY x.id ORDER BY score DESC, y.id) AS rn FROM p JOIN memories x ON x.vec_id = a JOIN memories y ON y.vec_id = b AND y.tenant_id = x.tenant_id WHERE score >= 0.5)
SELECT src_id, target_id, 'supports' AS relation_type, printf('similarity:%.2f', score) AS context_label FROM c WHERE rn <= 6 AND src_id <> target_id
  AND NOT EXISTS (SELECT 1 FROM memory_relations r WHERE r.src_id = c.src_id AND r.target_id = c.target_id)""")
def cross_reconcile(t):
    owned = rows(t).join(t.memory.select(F.col("id").alias("memory_id"), F.col("tenant_id").alias("store")), "memory_id")
    return vectors.cross_reconcile(owned, t.memory_relations, 6, 0.5)


@query("noise_similarity", f"""SELECT fact_id AS id, max(round({SIMILAR}, 6)) AS noise_score, max(round({SIMILAR}, 6)) >= 0.4 AS is_noise
 FROM facts f JOIN embeddings q ON q.vec_id = f.vec_id JOIN (SELECT * FROM embeddings JOIN (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label) USING (label, vec_id)) e ON TRUE GROUP BY fact_id""")
def noise_similarity(t):
    firsts = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    prototypes = t.embeddings.join(firsts, ["label", "vec_id"]).select(F.col("label").alias("prototype_id"), "embedding")
    facts = t.facts.join(t.embeddings.select("vec_id", "embedding"), "vec_id").select(F.col("fact_id").alias("id"), "embedding")
    return vectors.noise_similarity(facts, prototypes, 0.4)
