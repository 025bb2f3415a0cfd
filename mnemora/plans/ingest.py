"""From messages and extracted facts to stored memories, for all conversations at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import compute_once
from ..operators import chunking, graph, ranking, reconcile, session_memory, updates
from ..operators.vectors import noise_similarity
from ..session import cut_lineage, stored


@dataclass
class Ingested:
    messages: DataFrame
    rejected: DataFrame
    upgrades: DataFrame
    merged: DataFrame
    inserts: DataFrame
    updates: DataFrame
    edges: DataFrame
    counts: DataFrame


def usable_messages(messages: DataFrame) -> DataFrame:
    """Recent messages within the budget, without tool chatter, private parts blanked and fully private rows dropped."""
    recent = ranking.select_recent(messages)
    said = recent.filter(~tx.is_meta(F.col("content")) & ~tx.fully_private(F.col("content")))
    return said.withColumn("content", tx.redact_private(F.col("content")))


def ingest(messages: DataFrame, stored_messages: DataFrame, facts: DataFrame, decisions: DataFrame, memories: DataFrame,
           vectors: DataFrame, categories: DataFrame, aliases: DataFrame, prototypes: DataFrame, as_of,
           preset: str = "high_recall") -> Ingested:
    """Facts (with embedding) and decisions come from models as tables.

    Order: message dedup and selection, fact preparation, noise and artifact filters, admission, private tagging,
    exact dedup, session merge, decisions. The admitted facts are checkpointed: three later steps read them.
    """
    fresh = graph.dedup_messages(messages, stored_messages)
    said = usable_messages(fresh)
    prepared = reconcile.with_importance(reconcile.prepare_facts(facts, categories, aliases), categories)
    vectored = noise_similarity(prepared.select(F.col("fact_id").alias("id"), "embedding"), prototypes)
    clean = prepared.join(vectored.filter("is_noise").select(F.col("id").alias("fact_id")), "fact_id", "left_anti").filter(
        ~tx.is_noise(F.col("l0_abstract")) & ~tx.is_compression_artifact(F.col("l2_content")))
    talk = session_memory.extract_window(said).withColumnRenamed("window", "conversation")
    scored = reconcile.admission_gate(
        reconcile.admission_score(clean.join(talk.withColumnRenamed("conv_id", "batch_id"), "batch_id", "left"), memories, vectors, as_of),
        preset)
    scored = cut_lineage(scored)
    admitted = reconcile.tag_private(scored.filter("admitted"))
    candidates = reconcile.gather_existing(admitted, memories, vectors)
    outcome = cut_lineage(reconcile.exact_dedup(admitted, memories, candidates))
    open_facts = admitted.join(outcome.filter("outcome = 'new'").select("fact_id"), "fact_id", "left_semi")
    merged, left = reconcile.session_fast_merge(open_facts, memories, as_of)
    left = cut_lineage(left)
    decided = decisions.join(left.select("batch_id", "fact_index"), ["batch_id", "fact_index"], "left_semi")
    applied = reconcile.apply_decisions(left, memories, decided)
    inserts = reconcile.facts_to_memories(
        left.join(applied.inserts.select("batch_id", "fact_index"), ["batch_id", "fact_index"], "left_semi"), as_of)
    counts = scored.groupBy("hint").agg(F.count("*").alias("n"))
    return Ingested(said, scored.filter("NOT admitted"), reconcile.upgraded_rows(admitted, outcome, as_of), merged, inserts,
                    applied.updates, applied.edges, counts)


CHANGED = ("content", "l0_abstract", "l1_overview", "l2_content", "tags", "confidence", "importance", "superseded_by")


def memory_table(memories: DataFrame, inserts: DataFrame, as_of, *changes: DataFrame) -> DataFrame:
    """The table behind an ingest: ``memories`` with all ``changes`` by id, of which a later one stands column by column where it
    has a value, and the inserts. Changed rows get version + 1 and a new update time.

    Ids are strings then. Each of ``changes`` has one row per id and any of the columns ``CHANGED``; unknown ids are ignored.
    Inserts replace rows of their ids, so ingesting a batch twice gives the table that once gives.
    """
    kinds = dict(memories.dtypes)
    names = [c for c in CHANGED if c in kinds]
    rows = None
    for stage, change in enumerate(changes):
        part = change.select(
            F.col("id").cast("string").alias("id"), F.lit(stage).alias("_stage"),
            *[(F.col(c) if c in change.columns else F.lit(None)).cast("string" if c == "superseded_by" else kinds[c]).alias(c) for c in names])
        rows = part if rows is None else rows.unionByName(part)
    old = memories.withColumn("id", F.col("id").cast("string")).join(inserts.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
    if "superseded_by" in names:
        old = old.withColumn("superseded_by", F.col("superseded_by").cast("string"))
    if rows is not None:
        last = rows.groupBy("id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_stage"))).alias(f"_{c}") for c in names])
        joined = old.join(last.withColumn("_changed", F.lit(True)), "id", "left")
        merged = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in names})
        old = updates.touched(merged, F.col("_changed").isNotNull(), as_of).drop("_changed", *[f"_{c}" for c in names])
    made = inserts.select(*[(F.col(c) if c in inserts.columns else F.lit(None)).cast(dict(old.dtypes)[c]).alias(c) for c in old.columns])
    return old.unionByName(made)


def relation_table(relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations with the new edges, each (src_id, relation_type, target_id) once. Ids are strings then."""
    columns = ["src_id", "relation_type", "target_id"]
    both = [df.select(F.col("src_id").cast("string").alias("src_id"), "relation_type", F.col("target_id").cast("string").alias("target_id"))
            for df in (relations, edges)]
    return both[0].unionByName(both[1]).dropDuplicates(columns)


def commit(ingested: Ingested, memories: DataFrame, relations: DataFrame, folder: str, batch_id: str, as_of) -> tuple[DataFrame, DataFrame]:
    """(memories, relations) behind an ingest, written below ``folder`` under the batch's id: a batch that runs again replaces what
    it wrote. The next ingest reads them."""
    table = memory_table(memories, ingested.inserts, as_of, ingested.upgrades, ingested.merged, ingested.updates)
    return stored(table, "memories", f"{folder}/{batch_id}"), stored(relation_table(relations, ingested.edges), "relations", f"{folder}/{batch_id}")


def import_batch(files: DataFrame, stored: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(import rows, counts). ``files``: task_id, file_no, text, strategy. ``stored``: content_hash of earlier imports.

    A file that is stored already is rejected unless forced. Each accepted one is cut by
    its strategy, or by the kind of its content: conversations and large texts overlap, documents split at headings.
    """
    hashed = files.withColumn("content_hash", F.sha2("text", 256))
    known = stored.select("content_hash").distinct().withColumn("_known", F.lit(True))
    judged = hashed.join(known, "content_hash", "left").withColumn("rejected", F.col("_known").isNotNull() & F.lit(not force))
    accepted = judged.filter("NOT rejected")
    text = F.col("text")
    kind = F.when(F.col("strategy") != "auto", F.col("strategy")).otherwise(tx.content_kind(text)).alias("kind")
    # each text is judged once; only texts longer than a chunk may overlap, and which of them do is asked again
    overlaps = F.col("kind").isin("conversation", "large")
    long = (F.octet_length("text") > chunking.SIZE) & ~F.col("rejected")
    cut = chunking.split_overlap(judged.filter(long).select("task_id", "file_no", "text", kind).filter(overlaps).select(
        F.struct("task_id", "file_no", "kind").alias("id"), "text")).select("id.*", F.col("chunk_no").alias("part_no"), F.col("chunk").alias("content"))
    pieces = F.when(F.col("kind") == "structured", tx.split_sections(text)).otherwise(F.array(text))
    others = compute_once(accepted, kind=kind).filter(~(overlaps & (F.octet_length("text") > chunking.SIZE))).select(
        "task_id", "file_no", "kind", F.posexplode(pieces).alias("part_no", "content"))
    parts = others.unionByName(cut).withColumn("id", F.concat_ws("/", "task_id", F.col("file_no").cast("string"))).withColumn(
        "session_id", F.concat(F.lit("import-"), "task_id"))
    per_file = judged.groupBy("task_id").agg(
        F.count("*").alias("files"), F.count_if("rejected").alias("rejected"))
    return parts, per_file.join(parts.groupBy("task_id").agg(F.count("*").alias("parts")), "task_id", "left").fillna(0, ["parts"])


def rollback_import(memories: DataFrame, task_id: str, started, source: str = "intelligence") -> DataFrame:
    """Memories without the rows of the import's session and the rows its analysis wrote since the start."""
    from ..functions import times

    of_session = F.col("session_id") == f"import-{task_id}"
    of_source = (F.col("source") == source) & (F.col("created_at") >= times.moment(started))
    return memories.filter(~F.coalesce(of_session | of_source, F.lit(False)))
