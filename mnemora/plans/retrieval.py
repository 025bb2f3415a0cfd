"""Hybrid retrieval for a table of queries: vector and text legs, fusion, and the re-scoring stages.

Every stage maps candidates (query_id, memory_id, score, ..) to candidates, so stages can be used alone. Stage order
and numbers are fixed values of the pipeline. Per query there are at most a few hundred candidates after the legs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions import text as tx
from ..functions.scoring import Decay
from ..operators import blocks, filters, graph, ranking
from ..operators.diversity import repeated
from ..operators.ranking import top_n
from ..operators.text_search import text_topk
from ..operators.vectors import vector_topk
from ..session import cut_lineage, stored


@dataclass(frozen=True)
class Settings:
    limit: int = 20
    fetch_factor: int = 3
    cap_factor: int = 2
    rrf_k: float = 60.0
    vector_weight: float = 0.7
    text_weight: float = 0.3
    tag_weight: float = 0.2
    pinned_boost: float = 1.5
    min_score: float = 0.15
    rerank_share: float = 0.6
    floor_from: float = 0.75
    floor_share: float = 0.95
    hard_cutoff: float = 0.005
    same_text: float = 0.85
    same_text_factor: float = 0.5
    judged: int = 15
    related: int | None = 20
    strategy: str = "balanced"
    decay: Decay = field(default_factory=Decay)


def merge_legs(vector: DataFrame, text: DataFrame) -> DataFrame:
    """Union of the legs by id, scores added."""
    return vector.select("query_id", "memory_id", "score").unionByName(
        text.select("query_id", "memory_id", "score")
    ).groupBy("query_id", "memory_id").agg(F.sum("score").alias("score"))


def query_access(queries: DataFrame, spaces: DataFrame) -> DataFrame:
    """Adds ``access_keys``, what the agent of each query may open in the store of its tenant and in shared spaces, and
    ``stores``, where that lies. ``spaces``: user_id, space_id of accessible spaces."""
    shared = spaces.groupBy(F.col("user_id").alias("tenant_id")).agg(
        F.collect_set(F.concat(F.lit("shared:"), "space_id")).alias("_shared"))
    own = F.array_compact(F.array(
        F.concat("tenant_id", F.lit("/global")),
        F.when(F.col("agent_id") != "", F.concat("tenant_id", F.lit("/private:"), "agent_id"))))
    others = F.coalesce("_shared", F.array().cast("array<string>"))
    return queries.join(shared, "tenant_id", "left").withColumns({
        "access_keys": F.concat(own, others), "stores": F.concat(F.array("tenant_id"), others)}).drop("_shared")


def keyed(memories: DataFrame) -> DataFrame:
    """``memories`` with access_key and store, where they have none."""
    made = {"access_key": filters.store_key(), "store": filters.store_name()}
    return memories.withColumns({name: key for name, key in made.items() if name not in memories.columns})


def asking(queries: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the queries and what they filter by."""
    return queries.select(*columns, *[c for c in blocks.QUERY_FILTERS if c in queries.columns])


def vector_leg(queries: DataFrame, memories: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, memory_id, score, rank), filtered before the top k.

    ``queries``: query_id, embedding, access_keys, project_path [, scope, global_scope]: null filters let every row pass;
    ``global_scope`` is ``only`` (rows without a path) or ``exclude``.
    """
    rows = keyed(memories).select(
        F.col("id").alias("memory_id"), *blocks.ROW_FILTERS
    ).join(vectors.select(F.col("id").alias("memory_id"), "embedding"), "memory_id")
    hits = vector_topk(asking(queries, "query_id", "embedding"), rows, k, 0.0)
    return ranking.rank_leg(hits.withColumn("leg", F.lit("vector"))).drop("leg")


def text_leg(queries: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(query_id, memory_id, text_score, rank): the best ``k`` texts of what a query may open, with the counts of their stores.

    ``queries``: query_id, query_text, stores and the filters of ``vector_leg``. The score kept for later stages is clamped to
    [0, 1]; ranks follow the unclamped one.
    """
    seen = text_topk(asking(queries, "query_id", "query_text", "stores"), keyed(memories), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("text_score"), "memory_id")
    return seen.withColumn("rank", F.row_number().over(order)).select(
        "query_id", "memory_id", F.least(F.col("text_score"), F.lit(1.0)).alias("text_score"), "rank")


def tag_leg(candidates: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, memory_id, rank) of candidates that share tags with the query, most shared first."""
    tagged = candidates.select("query_id", "memory_id").distinct().join(
        queries.select("query_id", F.col("tags").alias("_wanted")).filter(F.size("_wanted") > 0), "query_id"
    ).join(memories.select(F.col("id").alias("memory_id"), "tags"), "memory_id")
    shared = tagged.withColumn("_n", F.size(F.array_intersect("tags", "_wanted"))).filter("_n > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("_n"), "memory_id")
    return shared.select("query_id", "memory_id", F.row_number().over(order).alias("rank"))


def rrf_fuse(vector: DataFrame, text: DataFrame, tags: DataFrame | None, memories: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, memory_id, score, text_score): weighted reciprocal ranks, weights over their sum, pinned rows lifted."""
    total = s.vector_weight + s.text_weight + s.tag_weight

    def leg(df: DataFrame, weight: float, text_score: Column) -> DataFrame:
        part = F.lit(weight / total) / (F.lit(s.rrf_k) + F.col("rank"))
        return df.select("query_id", "memory_id", part.alias("part"), text_score.alias("text_score"))

    legs = leg(vector, s.vector_weight, F.lit(0.0)).unionByName(leg(text, s.text_weight, F.col("text_score")))
    if tags is not None:
        legs = legs.unionByName(leg(tags, s.tag_weight, F.lit(0.0)))
    fused = legs.groupBy("query_id", "memory_id").agg(F.sum("part").alias("score"), F.max("text_score").alias("text_score"))
    kinds = memories.select(F.col("id").alias("memory_id"), "memory_type")
    lifted = F.when(F.col("memory_type") == "pinned", F.col("score") * s.pinned_boost).otherwise(F.col("score"))
    return fused.join(kinds, "memory_id").withColumn("score", lifted).select("query_id", "memory_id", "score", "text_score")


def min_score_filter(candidates: DataFrame, low: float) -> DataFrame:
    return candidates.filter(F.col("score") >= low)


def expand(candidates: DataFrame, relations: DataFrame, memories: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Candidates and what they are related to, as far as the query may open it."""
    added = graph.expand_relations(candidates, relations, keyed(memories), s.related, queries)
    return candidates.unionByName(added.withColumn("text_score", F.lit(0.0)), allowMissingColumns=True)


def blend_rerank(candidates: DataFrame, reranked: DataFrame | None, share: float = 0.6) -> DataFrame:
    """Keeps the score as ``pre_score``; with an answer table the rerank score is blended in, missing ones count 0."""
    kept = candidates.withColumn("pre_score", F.col("score"))
    if reranked is None:
        return kept
    answer = reranked.select("query_id", "memory_id", "rerank_score")
    blended = F.coalesce("rerank_score", F.lit(0.0)) * share + F.col("pre_score") * (1.0 - share)
    return kept.join(answer, ["query_id", "memory_id"], "left").withColumn("score", blended).drop("rerank_score")


def text_floor(candidates: DataFrame, s: Settings = Settings()) -> DataFrame:
    floor = F.col("pre_score") * s.floor_share
    return candidates.withColumn("score", F.when(
        F.col("text_score") >= s.floor_from, F.greatest("score", floor)).otherwise(F.col("score")))


def decay_boost(candidates: DataFrame, as_of, decay: Decay = Decay()) -> DataFrame:
    return candidates.withColumn("score", F.col("score") * scoring.search_boost(as_of, decay))


def importance_weight(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", F.col("score") * (0.7 + 0.3 * F.col("importance")))


def length_normalize(candidates: DataFrame) -> DataFrame:
    text = F.when(F.col("l0_abstract") == "", F.col("content")).otherwise(F.col("l0_abstract"))
    size = F.octet_length(text) / 500.0
    factor = F.greatest(F.lit(1.0), 1.0 + F.when(size > 0, F.log2(size)).otherwise(0.0))
    return candidates.withColumn("score", F.col("score") / factor)


def diversity(candidates: DataFrame, s: Settings = Settings(), texts: DataFrame | None = None, held: int | None = None) -> DataFrame:
    """Halves, once, the score of a row whose content is nearly that of a better one; then the best ``limit`` rows.

    Where the best ``held`` rows of a query keep ``limit`` rows that are not halved, no later row can pass these, so only they meet
    their texts; else more are held, until all queries are settled. ``texts``: memory_id, content, where the candidates have none.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    held = held or max(1024, 8 * s.limit)
    while True:
        fresh = F.count_if((F.col("_rank") <= held) & F.col("_alike").isNull() & (F.col("score") >= 0))
        ranked = stored(candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= held + 1), "ranked")
        asked = ranked.filter(F.col("_rank") <= held).select("query_id", "memory_id", F.col("_rank").alias("place"))
        known = ranked.select("memory_id", "content").dropDuplicates(["memory_id"]) if texts is None else texts
        tokens = known.join(asked.select("memory_id"), "memory_id", "left_semi").select(
            "memory_id", F.transform(tx.content_set(F.col("content")), lambda t: F.xxhash64(t)).alias("tokens"))
        alike = repeated(asked.join(tokens, "memory_id"), s.same_text, held)
        judged = stored(ranked.join(alike.withColumn("_alike", F.lit(True)), ["query_id", "memory_id"], "left"), "judged")
        unsettled = judged.groupBy("query_id").agg(F.max("_rank").alias("n"), fresh.alias("fresh")).filter(
            (F.col("n") > held) & (F.col("fresh") < s.limit))
        if unsettled.isEmpty():
            break
        held *= 8
    halved = judged.filter(F.col("_rank") <= held).withColumn(
        "score", F.when(F.col("_alike"), F.col("score") * s.same_text_factor).otherwise(F.col("score")))
    return top_n(halved, ["query_id"], [F.desc("score"), F.col("memory_id")], s.limit).drop("_rank", "_alike")


def apply_relevance(candidates: DataFrame, verdicts: DataFrame | None, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded). The best ``judged`` rows need a verdict other than irrelevant; strict also drops medium.

    ``verdicts``: query_id, memory_id, relevance. Rows behind the judged ones stay.
    """
    if verdicts is None or s.strategy == "loose":
        plain = candidates.withColumn("relevance", F.lit(None).cast("string"))
        return plain, plain.limit(0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    ranked = candidates.withColumn("_place", F.row_number().over(order)).join(
        verdicts.select("query_id", "memory_id", "relevance"), ["query_id", "memory_id"], "left")
    bad = ["irrelevant", "medium"] if s.strategy == "strict" else ["irrelevant"]
    judged = F.col("_place") <= s.judged
    good = F.col("relevance").isNotNull() & ~F.col("relevance").isin(bad)
    kept = ranked.filter(~judged | good).withColumn("relevance", F.when(judged, F.col("relevance")))
    return kept.drop("_place"), ranked.filter(judged & F.col("relevance").isin(bad)).drop("_place")


@dataclass
class SearchResult:
    results: DataFrame
    discarded: DataFrame
    stages: list[tuple[str, DataFrame]]


ATTRIBUTES = ("importance", "confidence", "tier", "access_count", "created_at", "last_accessed_at", "content", "l0_abstract")


def search(queries: DataFrame, memories: DataFrame, vectors: DataFrame, relations: DataFrame, as_of,
           reranked: DataFrame | None = None, verdicts: DataFrame | None = None, settings: Settings = Settings(),
           active_only: bool = False, legs: tuple[DataFrame, DataFrame] | None = None) -> SearchResult:
    """All stages for all queries. ``legs``: vector and text hits made before, of these queries and maybe others.

    ``queries``: query_id, query_text, embedding, stores, access_keys, project_path [, scope, global_scope, tags, min_score];
    ``memories`` [access_key, store]: see ``keyed``. The legs are the heavy part; their
    fusion is checkpointed, so the stages behind it, which read their input more than once, do not repeat the legs.
    """
    s = settings
    if active_only:
        memories = memories.filter(F.col("state") == "active")
    k = s.limit * s.fetch_factor
    if legs is None:
        vector, text = vector_leg(queries, memories, vectors, k), text_leg(queries, memories, k)
    else:
        vector, text = (hits.filter(F.col("rank") <= k).join(queries.select("query_id"), "query_id", "left_semi") for hits in legs)
    tags = None
    if "tags" in queries.columns:
        if legs is None:
            vector, text = cut_lineage(vector), cut_lineage(text)
        tags = tag_leg(vector.select("query_id", "memory_id").unionByName(text.select("query_id", "memory_id")), queries, memories)
    fused = cut_lineage(rrf_fuse(vector, text, tags, memories, s))
    normal = ranking.minmax(fused)
    if "min_score" in queries.columns:
        asked = queries.select("query_id", "min_score")
        scored = normal.join(asked, "query_id").filter(F.col("score") >= F.col("min_score")).drop("min_score")
    else:
        scored = min_score_filter(normal, s.min_score)
    capped = ranking.topk_cap(scored, s.limit * s.cap_factor)
    expanded = expand(capped, relations, memories, queries, s)
    blended = text_floor(blend_rerank(expanded, reranked, s.rerank_share), s)
    known = memories.select(F.col("id").alias("memory_id"), *ATTRIBUTES)
    weighed = length_normalize(importance_weight(decay_boost(blended.join(known, "memory_id"), as_of, s.decay)))
    cut = cut_lineage(weighed.filter(F.col("score") >= s.hard_cutoff).select(
        "query_id", "memory_id", "score", "content"))
    diverse = diversity(cut, s)
    kept, discarded = apply_relevance(diverse, verdicts, s)
    stages = [("rrf_fusion", fused), ("rrf_normalize", normal), ("min_score_filter", scored), ("topk_cap", capped),
              ("expand_relations", expanded), ("hard_cutoff", cut), ("diversity", diverse), ("relevance", kept)]
    return SearchResult(kept, discarded, stages)


def space_queries(queries: DataFrame, spaces: DataFrame) -> DataFrame:
    """One query per (query, space that its tenant may open), with an id, a store and access keys of its own.

    ``queries``: query_id, tenant_id, agent_id and what ``search`` takes. ``spaces``: user_id, space_id, weight, each pair once.
    Adds search_id. Null agents open no private rows.
    """
    reach = spaces.groupBy(F.col("user_id").alias("tenant_id")).agg(F.collect_set("space_id").alias("_reach"))
    each = spaces.select(F.col("user_id").alias("tenant_id"), "space_id", "weight")
    named = queries.drop("space_id", "weight").join(each, "tenant_id").join(reach, "tenant_id")
    keys = F.concat(
        F.array_compact(F.array(F.lit("global"), F.when(F.col("agent_id") != "", F.concat(F.lit("private:"), "agent_id")))),
        F.transform("_reach", lambda s: F.concat(F.lit("shared:"), s)))
    own = F.col("query_id").cast("string")
    return named.withColumns({
        "search_id": F.concat(F.length(own), F.lit(":"), own, "space_id"),
        "stores": F.array("space_id"),
        "access_keys": F.transform(keys, lambda k: F.concat("space_id", F.lit("|"), k)),
    }).drop("_reach")


def merge_spaces(hits: DataFrame, limit: int | None = 20) -> DataFrame:
    """Hits of several spaces on one scale: score over the best of its query and space, times the weight; best ``limit``.

    ``hits``: query_id, space_id, weight, memory_id, score and more. Where no score of a space is above 0, all count 0.
    """
    best = F.max("score").over(Window.partitionBy("query_id", "space_id"))
    scaled = F.when(best > 0, F.col("score") / best).otherwise(0.0) * F.col("weight")
    return ranking.topk_cap(hits.withColumn("score", scaled), limit)


def search_spaces(queries: DataFrame, memories: DataFrame, vectors: DataFrame, relations: DataFrame, spaces: DataFrame, as_of,
                  reranked: DataFrame | None = None, verdicts: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(query_id, space_id, memory_id, score, relevance): ``search`` in every space of a query on its own, put on one scale.

    Each (query, space) has its own legs, top k, text counts, expansion and cuts. ``memories`` carry space_id; rows without one
    are in no space. ``queries`` and ``spaces``: see ``space_queries``. ``reranked`` and ``verdicts`` are by query_id and memory_id.
    """
    asked = cut_lineage(space_queries(queries, spaces))
    names = asked.select("search_id", "query_id", "space_id", "weight")
    placed = memories.filter(F.col("space_id").isNotNull()).withColumns({
        "access_key": F.concat("space_id", F.lit("|"), filters.access_key()), "store": F.col("space_id")})

    def by_search(answers: DataFrame | None) -> DataFrame | None:
        return answers if answers is None else answers.join(names.select("query_id", "search_id"), "query_id").drop(
            "query_id").withColumnRenamed("search_id", "query_id")

    found = search(asked.drop("query_id").withColumnRenamed("search_id", "query_id"), placed, vectors, relations, as_of,
                   by_search(reranked), by_search(verdicts), settings).results
    hits = found.withColumnRenamed("query_id", "search_id").join(names, "search_id")
    return merge_spaces(hits, settings.limit).select("query_id", "space_id", "memory_id", "score", "relevance")
