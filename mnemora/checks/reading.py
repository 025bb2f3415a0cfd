import pandas as pd
from pyspark.sql import functions as F

from ..operators import chunking
from ..session import stored
from ..sources import files, jsonl, memories, transcripts, webhooks
from ..streaming import flows
from .registry import query
from .texts import fold, strip_sql


@query("decode_memories", """SELECT id, 'active' AS state, 0.5::DOUBLE AS importance, (SELECT count(*) FROM memory_tags g WHERE g.id = m.id) AS n_tags, shared_from_memory::VARCHAR AS shared_from_memory, source_version,
 created_s, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_relations FROM memories m""")
def decode_memories(t):
    """Memories written as stored rows with JSON text, some of it broken, and columns missing."""
    raw = t.memory.select(
        "id", F.to_json("tags").alias("tags"), F.when(F.col("id") % 5 == 0, "{broken").otherwise('[{"relation_type":"supports","target_id":"7"}]').alias("relations"),
        F.when(F.col("shared_from_memory").isNotNull(), F.to_json(F.struct(F.col("shared_from_memory").cast("string").alias("shared_from_memory"), "source_version"))).alias("provenance"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return memories.decode_memories(raw).select(
        "id", "state", "importance", F.size("tags").cast("bigint").alias("n_tags"), "shared_from_memory", "source_version",
        F.unix_seconds("created_at").alias("created_s"), F.size("relations").cast("bigint").alias("n_relations"))


def stored_rows(t):
    """Memories as they are stored, some JSON text broken, columns missing."""
    return t.memory.select(
        "id", "content", "space_id", F.to_json("tags").alias("tags"), F.when(F.col("id") % 5 == 0, "{broken").otherwise('[{"relation_type":"supports","target_id":"7"}]').alias("relations"),
        F.when(F.col("id") % 3 == 0, F.col("importance")).alias("importance"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


@query("read_memories", """SELECT id, content, space_id, CASE WHEN id % 3 = 0 THEN importance ELSE 0.5::DOUBLE END AS importance, (SELECT count(*) FROM memory_tags g WHERE g.id = m.id) AS n_tags, created_s,
 CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS n_relations, 'active' AS state FROM memories m""")
def read_memories(t):
    """Written by space and read back."""
    folder = flows.work_folder(t.spark, "memories")
    memories.write_memories(stored_rows(t), folder)
    rows = memories.read_memories(t.spark, folder)
    return rows.select("id", "content", F.coalesce("space_id", F.lit("")).alias("space_id"), "importance", F.size("tags").cast("bigint").alias("n_tags"),
                       F.unix_seconds("created_at").alias("created_s"), F.size("relations").cast("bigint").alias("n_relations"), "state")


@query("read_memories_of_space", "SELECT space_id, count(*) AS n, sum(length(content)) AS chars FROM memories WHERE space_id = 'team/t1' GROUP BY 1")
def read_memories_of_space(t):
    """One space: the scan reads its folder only."""
    folder = flows.work_folder(t.spark, "memories")
    memories.write_memories(stored_rows(t), folder)
    rows = memories.read_memories(t.spark, folder).filter("space_id = 'team/t1'")
    return rows.groupBy("space_id").agg(F.count("*").alias("n"), F.sum(F.char_length("content")).alias("chars"))


@query("read_sessions", "SELECT session_id, conv_id, turn, role, content, agent_id, created_s FROM session_messages")
def read_sessions(t):
    folder = flows.work_folder(t.spark, "sessions")
    t.session_messages.write.parquet(folder)
    return memories.read_sessions(t.spark, folder)


@query("stream_read_sessions", "SELECT session_id, conv_id, turn, role, content, agent_id, created_s FROM session_messages")
def stream_read_sessions(t):
    """Files that come one after another, two triggers."""
    folder, sink = flows.work_folder(t.spark, "sessions"), flows.work_folder(t.spark, "read")
    for part in (0, 1):
        t.session_messages.filter(F.col("turn") % 2 == part).write.mode("append").parquet(folder)
        rows = flows.drain(memories.read_sessions(t.spark, folder, stream=True), "append", folder=sink)
    return rows


@query("session_of", "SELECT conv_id, turn, content FROM session_messages WHERE session_id = 'sess-7'")
def session_of(t):
    return memories.session_of(t.session_messages, "sess-7").select("conv_id", "turn", "content")


@query("read_recall", "SELECT e.session_id, count(*) AS n, round(sum(score), 6) AS score FROM recall_events e JOIN recall_items i USING (event_id) GROUP BY 1")
def read_recall(t):
    folder = flows.work_folder(t.spark, "recall")
    t.recall_events.write.parquet(f"{folder}/events")
    t.recall_items.write.parquet(f"{folder}/items")
    events, items = memories.read_recall(t.spark, f"{folder}/events", f"{folder}/items")
    return events.join(items, "event_id").groupBy("session_id").agg(
        F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def blobs(t):
    """Spaces as stored: one JSON text each. Members are the users that shared into the space."""
    users = t.sharing_events.groupBy("to_space").agg(F.array_sort(F.collect_set(F.struct("user_id", F.lit("member").alias("role")))).alias("members"))
    rules = t.share_rules.groupBy("space_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rule_id").cast("string").alias("id"), "source_space", F.array("category").alias("categories"), "min_importance", "require_approval"))).alias("auto_share_rules"))
    return t.spaces.join(users, F.col("space_id") == F.col("to_space"), "left").join(rules, "space_id", "left").select(F.to_json(F.struct(
        F.col("space_id").alias("id"), "space_type", "owner_id", F.coalesce("members", F.array().cast("array<struct<user_id:string,role:string>>")).alias("members"), "auto_share_rules")).alias("data"))


@query("flatten_spaces", "SELECT s.space_id, space_type, owner_id, count(DISTINCT e.user_id)::INT AS n_members FROM spaces s LEFT JOIN sharing_events e ON e.to_space = s.space_id GROUP BY 1, 2, 3")
def flatten_spaces(t):
    return memories.flatten_spaces(blobs(t))[0].select("space_id", "space_type", "owner_id", "n_members")


@query("flatten_space_members", "SELECT DISTINCT to_space AS space_id, user_id, 'member' AS role FROM sharing_events")
def flatten_members(t):
    return memories.flatten_spaces(blobs(t))[1].select("space_id", "user_id", "role")


@query("flatten_space_rules", "SELECT space_id, rule_id::VARCHAR AS rule_id, source_space, min_importance, require_approval FROM share_rules")
def flatten_rules(t):
    return memories.flatten_spaces(blobs(t))[2].select("space_id", "rule_id", "source_space", "min_importance", "require_approval")


def exports(t):
    """One export per 50 memories, in both forms; entries of rows with bad labels have no id."""
    bad = t.labels.filter("quality = 0").select(F.col("doc_id").alias("id"), F.lit(True).alias("bad"))
    rows = t.memory.join(bad, "id", "left").select(
        F.floor(F.col("id") / 50).alias("no"),
        F.struct(F.when(F.col("bad").isNull(), F.col("id").cast("string")).alias("id"), "content", "category", "tenant_id",
                 F.when(F.col("id") % 2 == 0, F.col("owner_agent_id")).alias("agent_id"), "importance").alias("m"))
    grouped = rows.groupBy("no").agg(F.collect_list("m").alias("memories"))
    wrapped = F.to_json(F.struct("memories"))
    return grouped.select(F.concat(F.lit("export-"), F.col("no").cast("string")).alias("file_name"), F.when(F.col("no") % 2 == 0, wrapped).otherwise(F.to_json("memories")).alias("text"))


@query("import_json", """SELECT id::VARCHAR AS id, content, 'tenant-9' AS tenant_id, 'team/t9' AS space_id, CASE WHEN id % 2 = 0 THEN owner_agent_id ELSE 'importer' END AS agent_id, importance FROM memories
 WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""")
def import_json(t):
    return memories.import_json(exports(t), "tenant-9", "team/t9", "importer")[0].select("id", "content", "tenant_id", "space_id", "agent_id", "importance")


@query("import_json_counts", """SELECT concat('export-', id // 50) AS file_name, count(*) AS total, count(*) FILTER (l.doc_id IS NULL) AS stored, count(l.doc_id) AS skipped
 FROM memories LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON l.doc_id = id GROUP BY 1""")
def import_counts(t):
    return memories.import_json(exports(t), "tenant-9", "team/t9")[1]


def transcript_lines(t):
    """Conversation turns as transcript lines with four kinds of content."""
    kind = F.col("turn") % 4
    text = F.col("content")

    def line(content):
        return F.to_json(F.struct(F.col("role").alias("type"), F.concat("conv_id", F.lit("-"), "turn").alias("uuid"),
                                  F.struct("role", content.alias("content")).alias("message")))

    blocks = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")), F.struct(F.lit("thinking").alias("type"), F.lit("hidden").alias("text")))
    result = F.array(F.struct(F.lit("tool_result").alias("type"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")))
    used = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("run").alias("name"), F.struct(text.alias("q")).alias("input")))
    tagged = F.concat(F.lit("<system-reminder>x</system-reminder> "), text)
    value = F.when(kind == 0, line(tagged)).when(kind == 1, line(blocks)).when(kind == 2, line(result)).otherwise(line(used))
    return t.session_messages.select(
        F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.col("turn").alias("line_no"), value.alias("value"))


JSON_TEXT = "replace(replace(replace(content, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
TRANSCRIPT = f"""said AS (SELECT concat('conv-', conv_id) AS session_id, turn AS line_no, concat(conv_id, '-', turn) AS uuid, role, CASE turn % 4 WHEN 0 THEN content WHEN 1 THEN content
  WHEN 2 THEN 'tool_result: ' || left(content, 500) ELSE 'tool_use(run): ' || left(concat('{{"q":"', {JSON_TEXT}, '"}}'), 100) END AS raw FROM session_messages WHERE role IN ('user', 'assistant')),
parsed AS (SELECT session_id, line_no, uuid, role, {strip_sql(fold('raw'))} AS content FROM said)"""


@query("parse_transcripts", f"WITH {TRANSCRIPT} SELECT session_id, line_no, uuid, role, content, length(content) >= 100 AS kept FROM parsed")
def parse_transcripts(t):
    return transcripts.parse_transcripts(transcript_lines(t))


def write_files(lines, folder, mode="wb"):
    """Lines of each session as a file in ``folder``, in order of line_no; with mode ``ab``, behind what is there."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        system, at = jsonl.opened(folder)
        system.create_dir(at)
        name = f"{at}/{rows['session_id'].iloc[0]}.jsonl"
        old = b""
        if mode == "ab" and system.get_file_info(name).size:
            with system.open_input_file(name) as source:
                old = source.read()
        with system.open_output_stream(name) as out:
            out.write(old + "".join(f"{x}\n" for x in rows.sort_values("line_no")["value"]).encode())
        return pd.DataFrame({"name": [name]})

    lines.groupBy("session_id").applyInPandas(write, "name string").count()


@query("read_transcripts", f"WITH {TRANSCRIPT} SELECT session_id, line_no, uuid, role, content, length(content) >= 100 AS kept FROM parsed")
def read_transcripts(t):
    """From files of one session each, in ranges of 2 KB."""
    folder = flows.work_folder(t.spark, "transcripts")
    write_files(transcript_lines(t), folder)
    return transcripts.read_transcripts(t.spark, folder, splitBytes=2048)


@query("follow_transcripts", f"""WITH {TRANSCRIPT}, cut AS (SELECT session_id, max(line_no) FILTER (line_no < 3) AS last FROM parsed GROUP BY 1)
SELECT session_id, uuid, content, line_no > coalesce(last, -1) AS new FROM parsed JOIN cut USING (session_id)""")
def follow_transcripts(t):
    """A stream over files that grow between two runs; what lies behind the cursors of the first run is new."""
    source, folder = flows.work_folder(t.spark, "growing"), flows.work_folder(t.spark, "followed")
    lines = transcript_lines(t)
    write_files(lines.filter("line_no < 3"), source)
    first = flows.drain(transcripts.read_transcripts(t.spark, source, True, splitBytes=2048), "append", folder=folder)
    cursors = stored(transcripts.new_cursors(first), "cursors")
    write_files(lines.filter("line_no >= 3"), source, "ab")
    rows = flows.drain(transcripts.read_transcripts(t.spark, source, True, splitBytes=2048), "append", folder=folder)
    new = transcripts.after_cursor(rows, cursors).select("session_id", "uuid", F.lit(True).alias("new"))
    return rows.select("session_id", "uuid", "content").join(new, ["session_id", "uuid"], "left").fillna(False, ["new"])


@query("after_cursor", f"WITH {TRANSCRIPT} SELECT session_id, line_no FROM parsed p WHERE length(content) >= 100 AND line_no > CASE WHEN EXISTS (SELECT 1 FROM parsed c WHERE c.session_id = p.session_id AND c.line_no = 2) THEN 2 ELSE -1 END")
def after_cursor(t):
    rows = transcripts.parse_transcripts(transcript_lines(t))
    cursors = t.session_messages.select(F.concat(F.lit("conv-"), "conv_id").alias("session_id"), F.concat("conv_id", F.lit("-2")).alias("uuid")).distinct()
    return transcripts.after_cursor(rows, cursors).filter("kept").select("session_id", "line_no")


@query("new_cursors", f"WITH {TRANSCRIPT} SELECT session_id, arg_max(uuid, line_no) AS uuid FROM parsed GROUP BY 1")
def new_cursors(t):
    return transcripts.new_cursors(transcripts.parse_transcripts(transcript_lines(t)))


def payloads(t):
    """Each conversation turn as a webhook of one of five kinds."""
    kind = F.col("turn") % 5
    repo = F.struct(F.lit("o/r").alias("full_name")).alias("repository")
    user = F.struct(F.col("agent_id").alias("login")).alias("user")
    number = F.col("conv_id").alias("number")
    commit = F.struct(F.sha2("content", 256).alias("id"), F.col("content").alias("message"), F.struct(F.col("agent_id").alias("name")).alias("author"),
                      F.array(F.lit("src/a.py"), F.lit("README.md")).alias("added"), F.array(F.lit("b.RS")).alias("modified"))
    issue = F.struct(number, F.lit("T").alias("title"), F.col("content").alias("body"), user).alias("issue")
    pull = F.struct(number, F.lit("P").alias("title"), F.col("content").alias("body"), user, F.struct(F.lit("f").alias("ref")).alias("head"), F.struct(F.lit("main").alias("ref")).alias("base")).alias("pull_request")
    review = F.struct(F.when(F.col("conv_id") % 2 == 0, F.col("content")).otherwise("").alias("body"), F.lit("approved").alias("state"), user).alias("review")
    comment = F.struct(F.col("content").alias("body"), user).alias("comment")
    body = (F.when(kind == 0, F.to_json(F.struct(repo, F.array(commit).alias("commits")))).when(kind == 1, F.to_json(F.struct(repo, issue)))
            .when(kind == 2, F.to_json(F.struct(repo, issue, comment))).when(kind == 3, F.to_json(F.struct(repo, pull))).otherwise(F.to_json(F.struct(repo, pull, review))))
    event = F.array(*[F.lit(e) for e in ("push", "issues", "issue_comment", "pull_request", "pull_request_review")])[kind.cast("int")]
    return t.session_messages.select((F.col("conv_id") * 100 + F.col("turn")).alias("event_id"), event.alias("event_type"), body.alias("payload"))


WEBHOOKS = """w AS (SELECT conv_id * 100 + turn AS event_id, turn % 5 AS k, conv_id AS num, content AS txt, agent_id AS who, left(sha256(content), 8) AS short, sha256(content) AS sha FROM session_messages),
issue_rows AS (SELECT event_id, 'issue' AS kind, concat('Issue #', num, ': T', chr(10), 'By: ', who, chr(10), chr(10), txt) AS content, concat('repo:o/r|github:issue|issue:', num) AS tags FROM w WHERE k IN (1, 2)),
pull_rows AS (SELECT event_id, 'pull_request' AS kind, concat('PR #', num, ': P', chr(10), 'By: ', who, chr(10), 'Branch: f → main', chr(10), chr(10), txt) AS content, concat('repo:o/r|github:pull_request|pr:', num) AS tags FROM w WHERE k IN (3, 4)),
made AS (SELECT event_id, 'push' AS kind, concat('Commit ', short, ' by ', who, ': ', txt, chr(10), 'Changed files: src/a.py, README.md, b.RS') AS content, concat('repo:o/r|github:push|commit:', short) AS tags FROM w WHERE k = 0
 UNION ALL SELECT event_id, 'file_change', concat('[File changed: ', f, ' in commit ', sha, ']'), concat('repo:o/r|github:file_change|language:', CASE f WHEN 'b.RS' THEN 'rust' ELSE 'python' END, '|file:', f) FROM w, unnest(['src/a.py', 'b.RS']) u(f) WHERE k = 0
 UNION ALL SELECT * FROM issue_rows UNION ALL SELECT event_id, 'issue_comment', concat('Comment on issue #', num, ' by ', who, ':', chr(10), txt), concat('repo:o/r|github:issue_comment|issue:', num) FROM w WHERE k = 2
 UNION ALL SELECT * FROM pull_rows UNION ALL SELECT event_id, 'review', concat('Review on PR #', num, ' by ', who, ' (approved):', chr(10), txt), concat('repo:o/r|github:review|pr:', num) FROM w WHERE k = 4 AND num % 2 = 0)"""


@query("webhooks_to_memories", f"WITH {WEBHOOKS} SELECT event_id, kind, content, tags, 'github:o/r' AS source FROM made")
def webhooks_to_memories(t):
    return webhooks.webhooks_to_memories(payloads(t)).select("event_id", "kind", "content", F.array_join("tags", "|").alias("tags"), "source")


NAMES = """CASE page_id % 9 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'b.jpeg' WHEN 2 THEN 'c.mkv' WHEN 3 THEN 'd.PY' WHEN 4 THEN 'e.hpp' WHEN 5 THEN 'f.txt' WHEN 6 THEN 'g.json' WHEN 7 THEN 'h.bin' ELSE url END"""
MIMES = """CASE page_id % 9 WHEN 5 THEN 'text/plain' WHEN 6 THEN 'application/json' WHEN 8 THEN 'text/html' ELSE 'application/octet-stream' END"""


@query("classify_files", f"""WITH f AS (SELECT page_id, {NAMES} AS filename, {MIMES} AS mime FROM pages)
SELECT page_id, CASE WHEN filename LIKE '%.pdf' THEN 'pdf' WHEN filename LIKE '%.jpeg' THEN 'image' WHEN filename LIKE '%.mkv' THEN 'video' WHEN filename IN ('d.PY', 'e.hpp') THEN 'code' WHEN mime LIKE 'text/%' OR mime = 'application/json' THEN 'text' ELSE 'unknown' END AS kind,
 CASE filename WHEN 'd.PY' THEN 'python' WHEN 'e.hpp' THEN 'cpp' END AS language FROM f""")
def classify_files(t):
    rows = t.pages.select("page_id", F.expr(NAMES).alias("filename"), F.expr(MIMES).alias("mime"))
    return files.classify_files(rows).select("page_id", "kind", "language")


@query("files_to_memories", """SELECT sha256(concat('file/tenant-1/', url, '/0')) AS id, html AS content, 'entities' AS category, 'session' AS memory_type, concat('file:', url, '|chunk_type:text') AS tags, concat('file_upload:', url) AS source FROM pages WHERE strlen(html) <= 80000""")
def files_to_memories(t):
    chunks = chunking.split_overlap(t.pages.select(F.col("url").alias("id"), F.col("html").alias("text")))
    rows = chunks.select(F.col("id").alias("filename"), "chunk_no", F.lit("text").alias("chunk_type"), F.col("chunk").alias("content"),
                         F.lit("tenant-1").alias("tenant_id"), F.lit("agent-1").alias("agent_id"))
    return files.files_to_memories(rows).select("id", "content", "category", "memory_type", F.array_join("tags", "|").alias("tags"), "source")
