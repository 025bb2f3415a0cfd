"""Uploaded files: type by name and mime, chunks as memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .webhooks import language_of

# Name endings of the kinds, and extension -> language.
IMAGES = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "svg")
VIDEOS = ("mp4", "avi", "mov", "mkv", "webm")
LANGUAGES = {
    "rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "jsx": "jsx", "go": "go", "java": "java",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby",
}


def _ends(name: Column, endings) -> Column:
    return F.rlike(name, F.lit(r"\.(?:" + "|".join(endings) + ")$"))


def classify_files(files: DataFrame) -> DataFrame:
    """Adds kind and language; the first rule wins. ``files``: filename, mime. Contents are not read."""
    name, mime = F.col("filename"), F.coalesce("mime", F.lit(""))
    language = language_of(name, LANGUAGES)
    kind = (
        F.when(F.startswith(mime, F.lit("application/pdf")) | _ends(name, ["pdf"]), F.lit("pdf"))
        .when(F.startswith(mime, F.lit("image/")) | _ends(name, IMAGES), F.lit("image"))
        .when(F.startswith(mime, F.lit("video/")) | _ends(name, VIDEOS), F.lit("video"))
        .when(language.isNotNull(), F.lit("code"))
        .when(F.startswith(mime, F.lit("text/")) | mime.isin("application/json", "application/xml"), F.lit("text"))
        .otherwise(F.lit("unknown"))
    )
    return files.withColumn("kind", kind).withColumn("language", F.when(F.col("kind") == "code", language))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Names and sizes of the files below a folder; the content column is not selected, so it is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), "length", F.lit(None).cast("string").alias("mime"))


def files_to_memories(chunks: DataFrame) -> DataFrame:
    """One session memory per chunk. ``chunks``: filename, chunk_no, chunk_type, content, tenant_id, agent_id.

    A file without a name counts as one whose name is empty; a missing part must not drop out of the id.
    """
    name, tenant = F.coalesce("filename", F.lit("")), F.coalesce("tenant_id", F.lit(""))
    return chunks.select(
        F.sha2(F.concat_ws("/", F.lit("file"), tenant, name, F.col("chunk_no").cast("string")), 256).alias("id"),
        "content", F.lit("entities").alias("category"), F.lit("session").alias("memory_type"), "tenant_id", "agent_id",
        F.array(F.concat(F.lit("file:"), name), F.concat(F.lit("chunk_type:"), "chunk_type")).alias("tags"),
        F.concat(F.lit("file_upload:"), name).alias("source"))
