"""Chat transcripts: JSON lines with plain or block content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_transcript
from .jsonl import numbered_lines, read_lines

LINE = "type string, uuid string, message struct<role:string,content:string>"
BLOCKS = "array<struct<type:string,text:string,content:string,name:string,input:string>>"
MIN_CHARS = 100
RESULT_CHARS = 500
INPUT_CHARS = 100


def _result_text(content: Column) -> Column:
    """Text of a tool result: a string, or the text blocks and strings of a list."""
    parts = F.from_json(content, "array<string>")

    def part(x: Column) -> Column:
        block = F.when(F.get_json_object(x, "$.type") == "text", F.coalesce(F.get_json_object(x, "$.text"), F.lit(""))).otherwise("")
        return F.when(F.startswith(x, F.lit("{")), block).otherwise(x)

    listed = F.startswith(content, F.lit("[")) & parts.isNotNull()
    return F.when(listed, F.array_join(F.transform(parts, part), "\n")).otherwise(F.coalesce(content, F.lit("")))


def block_text(block: Column) -> Column:
    """Text of one block, null for thinking and unknown blocks."""
    kind = block["type"]
    return (
        F.when(kind == "text", F.coalesce(block["text"], F.lit("")))
        .when(kind == "tool_result", F.concat(F.lit("tool_result: "), F.substring(_result_text(block["content"]), 1, RESULT_CHARS)))
        .when(kind == "tool_use", F.concat(
            F.lit("tool_use("), F.coalesce(block["name"], F.lit("?")), F.lit("): "),
            F.substring(F.coalesce(block["input"], F.lit("undefined")), 1, INPUT_CHARS)))
    )


def parse_transcripts(lines: DataFrame, hosts=("memory",)) -> DataFrame:
    """User and assistant lines with flattened and cleaned text. ``lines``: session_id, line_no, value.

    Short texts are kept and flagged ``kept = false``: they move the cursor but are not ingested.
    """
    parsed = lines.withColumn("_d", F.from_json("value", LINE)).filter(
        F.col("_d.type").isin("user", "assistant") & F.col("_d.message.role").isin("user", "assistant"))
    content = F.col("_d.message.content")
    listed = F.get_json_object("value", "$.message.content[0]").isNotNull()
    texts = F.filter(F.transform(F.from_json(content, BLOCKS), block_text), lambda x: x.isNotNull() & (x != ""))
    raw = F.when(listed, F.array_join(texts, "\n")).otherwise(F.when(content == "[]", F.lit("")).otherwise(content))
    return parsed.select(
        "session_id", "line_no", F.col("_d.uuid").alias("uuid"), F.col("_d.message.role").alias("role"),
        clean_transcript(F.coalesce(raw, F.lit("")), hosts).alias("content"),
    ).withColumn("kept", F.char_length("content") >= MIN_CHARS)


def after_cursor(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Rows behind each session's cursor; an unknown cursor lets all rows through. ``cursors``: session_id, uuid."""
    place = messages.join(cursors, ["session_id", "uuid"]).groupBy("session_id").agg(F.min("line_no").alias("_cursor"))
    return messages.join(place, "session_id", "left").filter(
        F.col("_cursor").isNull() | (F.col("line_no") > F.col("_cursor"))).drop("_cursor")


def new_cursors(messages: DataFrame) -> DataFrame:
    """Last uuid of each session, short texts included."""
    return messages.groupBy("session_id").agg(F.max_by("uuid", "line_no").alias("uuid"))


def read_transcripts(spark: SparkSession, path: str, stream: bool = False, hosts=("memory",), **options) -> DataFrame:
    """Parsed lines of transcript files, one session per file, named by it.

    line_no is the number of a line in its file. In a stream, which takes lines as files grow and does not count again what it has
    read, it is the byte at which the line begins; both order the lines of a file. ``options``: glob, splitBytes.
    """
    lines = read_lines(spark, path, stream, **options)
    placed = lines.withColumn("line_no", F.col("start")) if stream else numbered_lines(lines)
    session = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl?$", "")
    return parse_transcripts(placed.select(session.alias("session_id"), "line_no", "value"), hosts)
