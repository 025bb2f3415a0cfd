from pyspark.sql import functions as F

from ..session import stored
from ..sources import transcripts, webhooks
from ..streaming import flows, gates
from . import reading
from .ingestion import open_memories, topics
from .reading import TRANSCRIPT, WEBHOOKS
from .registry import query
from .sharing import rules
from .graph import ACCESS
from .views import AS_OF, Tables


class Live(Tables):
    """The same tables and views, with one base table read as a stream."""

    def __init__(self, t: Tables, table: str):
        super().__init__(t.spark, t.path)
        self._table = table
        self._like = getattr(t, table)

    def _build(self, name):
        if name == self._table:
            return flows.stream_table(self.spark, self.path, name, self._like)
        return super()._build(name)


@query("stream_dedup_messages", "SELECT DISTINCT sha256(concat(session_id, role, content)) AS content_hash FROM session_messages")
def stream_dedup(t):
    live = Live(t, "conversations").session_messages.withColumn("created_at", F.timestamp_seconds("created_s"))
    twice = live.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    return flows.drain(flows.stream_dedup_messages(twice), "append").select("content_hash")


@query("stream_append_messages", "SELECT DISTINCT sha256(concat(session_id, role, content)) AS content_hash FROM session_messages")
def stream_append_messages(t):
    """Every message comes in two of three triggers."""
    twice = t.session_messages.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    messages = in_parts(t, twice.withColumn("part", (F.col("turn") + F.col("copy")) % 3), place=F.col("part"))
    return flows.drain(messages, "append", flows.append_new_messages(flows.work_folder(t.spark, "messages"))).select("content_hash")


def gate_input(t):
    """Recall events as queries; similarity to the previous query from the event's props."""
    return t.events.select(
        F.concat(F.lit("tenant-"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("sess-"), (F.col("user_id") % 10).cast("string"))).alias("session_id"),
        F.col("event_id").alias("query_id"), F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) % 20000).alias("ts"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("similarity"))


# The oracle walks each key recursively: from a request let through to the next one 30 s later or more.
GATE = """q AS (SELECT CASE WHEN event_type = 'error' THEN 'tenant-' || (user_id % 3) ELSE concat('tenant-', user_id % 3, ':sess-', user_id % 10) END AS gate_key, event_id AS query_id,
   CAST(floor(epoch(ts)) AS BIGINT) % 20000 AS ts_s, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS similarity FROM events),
f AS (SELECT gate_key, min(ts_s) AS ts_s FROM q GROUP BY 1),
slots AS (SELECT gate_key, ts_s FROM f UNION ALL SELECT s.gate_key, (SELECT min(q.ts_s) FROM q WHERE q.gate_key = s.gate_key AND q.ts_s >= s.ts_s + 30) FROM slots s WHERE EXISTS (SELECT 1 FROM q WHERE q.gate_key = s.gate_key AND q.ts_s >= s.ts_s + 30)),
firsts AS (SELECT q.gate_key, q.ts_s, min(query_id) AS query_id FROM q JOIN slots USING (gate_key, ts_s) GROUP BY 1, 2),
gated AS (SELECT q.gate_key, q.query_id, q.ts_s, CASE WHEN x.query_id IS NULL THEN 'rate_limited' WHEN similarity > 0.7 THEN 'similarity_too_high' ELSE 'ok' END AS reason FROM q LEFT JOIN firsts x ON x.query_id = q.query_id)"""


@query("recall_gate_batch", f"WITH RECURSIVE {GATE} SELECT gate_key, query_id, ts_s, reason = 'ok' AS allowed, reason FROM gated")
def recall_gate_batch(t):
    return gates.recall_gate_batch(gate_input(t))


def in_parts(t, rows, by=None, parts=3, place=None):
    """``rows`` as a stream of ``parts`` files in order of ``by``, or by their ``place`` from 0, one for each trigger."""
    folder = flows.work_folder(t.spark, "parts")
    if place is None:
        cuts = rows.approxQuantile(by, [i / parts for i in range(1, parts)], 0.0) if rows.count() else []
        place = sum([F.when(F.col(by) > c, 1).otherwise(0) for c in cuts], F.lit(0))
    kept = stored(rows.withColumn("_part", place), "cut")
    for part in range(parts):
        kept.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("recall_gate_stream", f"WITH RECURSIVE {GATE} SELECT gate_key, query_id, ts_s, reason = 'ok' AS allowed, reason FROM gated")
def recall_gate_stream(t):
    requests = in_parts(t, gate_input(t).withColumn("s", F.unix_seconds("ts")), "s")
    return flows.drain(requests, "append", gates.recall_gate(flows.work_folder(t.spark, "gate")))


def rejected(t):
    return t.embeddings.select(
        F.concat(F.lit("tenant-"), (F.col("vec_id") % 3).cast("string")).alias("tenant_id"), F.col("vec_id").alias("seq"), "embedding")


def prototypes(t):
    """The first vector of each label: as many as there are labels, a few tens."""
    firsts = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return [r["embedding"] for r in firsts.orderBy("label").limit(64).collect()]


# A tenant's vectors one by one, with the list of those learned so far.
NOISE = """v AS (SELECT concat('tenant-', vec_id % 3) AS tenant_id, vec_id AS seq, row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) AS n, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT a.tenant_id, a.n, list(b.n) AS close FROM v a JOIN v b ON a.tenant_id = b.tenant_id AND b.n < a.n AND round(list_cosine_similarity(a.e, b.e), 6) >= 0.4 GROUP BY 1, 2),
fixed AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label ORDER BY label LIMIT 64),
barred AS (SELECT DISTINCT tenant_id, n FROM v JOIN fixed f ON round(list_cosine_similarity(v.e, f.e), 6) >= 0.4),
told AS (SELECT v.tenant_id, v.n, v.seq, coalesce(close, []) AS close, b.n IS NOT NULL AS barred FROM v LEFT JOIN near USING (tenant_id, n) LEFT JOIN barred b ON b.tenant_id = v.tenant_id AND b.n = v.n),
steps AS (SELECT tenant_id, 0::BIGINT AS n, []::BIGINT[] AS ring, FALSE AS learned FROM v GROUP BY tenant_id
  UNION ALL SELECT s.tenant_id, t.n, CASE WHEN barred OR list_has_any(ring, close) THEN ring ELSE list_append(ring, t.n)[-20:] END, NOT (barred OR list_has_any(ring, close))
  FROM steps s JOIN told t ON t.tenant_id = s.tenant_id AND t.n = s.n + 1)"""
NOISE_SQL = f"WITH RECURSIVE {NOISE} SELECT tenant_id, seq, learned FROM steps JOIN v USING (tenant_id, n)"


@query("noise_learner_batch", NOISE_SQL)
def noise_learner_batch(t):
    return gates.noise_learner_batch(rejected(t), prototypes(t), 0.4, 20)


@query("noise_learner_stream", NOISE_SQL)
def noise_learner_stream(t):
    body = gates.noise_learner(flows.work_folder(t.spark, "noise"), prototypes(t), 0.4, 20)
    return flows.drain(in_parts(t, rejected(t), "seq"), "append", body)


@query("stream_transcripts", f"WITH {TRANSCRIPT} SELECT session_id, line_no, uuid, content FROM parsed WHERE length(content) >= 100")
def stream_transcripts(t):
    lines = reading.transcript_lines(Live(t, "conversations"))
    return flows.drain(transcripts.parse_transcripts(lines).filter("kept"), "append").select("session_id", "line_no", "uuid", "content")


@query("stream_webhooks", f"WITH {WEBHOOKS} SELECT event_id, kind, content, tags FROM made")
def stream_webhooks(t):
    made = webhooks.webhooks_to_memories(reading.payloads(Live(t, "conversations")))
    return flows.drain(made, "append").select("event_id", "kind", "content", F.array_join("tags", "|").alias("tags"))


@query("stream_session_memory")
def stream_session_memory(t):
    """Three triggers of topics in order of their sessions' time; the last row of each memory."""
    flows.use_rocksdb(t.spark)
    stream = in_parts(t, topics(t), "topic_no")
    rows = flows.drain(flows.keyed_session_memory(stream, open_memories(t), AS_OF), "append", lambda batch, n: batch.withColumn("batch", F.lit(n)))
    return rows.groupBy("id").agg(F.max_by(F.struct("session_id", "kind", "content", "l0_abstract", "l1_overview", "l2_content", "tags", "parent_id"), "batch").alias("r")).select("id", "r.*")


@query("stream_access_counts", "SELECT memory_id AS id, count(*) AS hits FROM (SELECT event_id % 1000 AS memory_id FROM events) GROUP BY 1")
def stream_access_counts(t):
    hits = Live(t, "events").events.select((F.col("event_id") % 1000).alias("id"))
    return flows.drain(flows.stream_access_counts(hits), "complete")


@query("stream_auto_share", f"""WITH {ACCESS}, h AS (SELECT m.id AS memory_id, r.space_id AS target_space, m.tenant_id AS user_id, rule_id FROM memories m JOIN share_rules r ON r.source_space = m.space_id AND NOT require_approval
  AND (r.category IS NULL OR r.category = m.category) AND (r.tag IS NULL OR EXISTS (SELECT 1 FROM memory_tags g WHERE g.id = m.id AND g.tag = r.tag)) AND m.importance >= min_importance JOIN access a ON a.user_id = m.tenant_id AND a.space_id = r.space_id)
SELECT memory_id, target_space, user_id, min(rule_id) AS rule_id FROM h WHERE NOT EXISTS (SELECT 1 FROM memories c WHERE c.shared_from_memory = h.memory_id AND c.space_id = h.target_space) GROUP BY 1, 2, 3""")
def stream_auto_share(t):
    share = flows.stream_auto_share(t.memory, t.spaces, t.space_members, rules(t), t.memory, AS_OF)
    return flows.drain(Live(t, "documents").memory, "append", share)


@query("stream_timeline", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def stream_timeline(t):
    events = Live(t, "events").events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
    return flows.drain(flows.stream_timeline(events), "complete").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# Three triggers. A trigger closes days by the newest event of those before it, less a day; a row is late for days that were closed a trigger earlier.
CLOSED = """e AS (SELECT event_id % 3 AS part, ts, event_type AS action, date_trunc('day', ts) + INTERVAL 1 DAY AS closes FROM events),
marks AS (SELECT part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 1 DAY AS mark FROM e GROUP BY part),
kept AS (SELECT e.* FROM e LEFT JOIN marks ON marks.part = e.part - 2 WHERE mark IS NULL OR closes > mark)"""


@query("stream_timeline_closed", f"""WITH {CLOSED} SELECT strftime(closes - INTERVAL 1 DAY, '%Y-%m-%d') AS day, action, count(*) AS n FROM kept
 WHERE closes <= (SELECT max(mark) FROM marks) GROUP BY 1, 2""")
def stream_timeline_closed(t):
    """In append mode: days come out once, when the watermark has passed them, and their state goes; later rows are dropped."""
    rows = t.events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"), (F.col("event_id") % 3).alias("part"))
    events = in_parts(t, rows, place=F.col("part"))
    return flows.drain(flows.stream_timeline(events), "append").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("stream_session_groups", """SELECT session_id, count(*) AS recalls, count(*) FILTER (recall_type = 'auto') AS auto, count(*) FILTER (recall_type = 'manual') AS manual,
 arg_max(query_text, (ts, event_id)) AS latest_query FROM recall_events GROUP BY session_id""")
def stream_session_groups(t):
    return flows.drain(flows.stream_session_groups(Live(t, "events").recall_events), "complete").drop("last_ts")
