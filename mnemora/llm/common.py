"""Session settings, shipping of this package to the executors, and files in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Settings of bounded Arrow batches; this package on the path of the Python workers."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    sources = {str(p.relative_to(PACKAGE.parent)): p.read_bytes() for p in sorted(PACKAGE.rglob("*.py"))}
    digest = hashlib.sha256(repr(sorted(sources.items())).encode()).hexdigest()[:16]
    context = spark.sparkContext
    if not any(f"mnemora-{digest}" in f for f in context.listFiles):
        archive = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"mnemora-{digest}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for name, data in sources.items():
                out.writestr(name, data)
        context.addPyFile(str(archive))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset (tests), one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, safe from lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go: Spark removes them once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that ``saved`` wrote and that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in sorted({name.rsplit("/", 1)[0] for name in df.inputFiles()}):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_splits(spark: SparkSession) -> None:
    """Hold the number of partitions that Spark aims at when it splits files, where it would follow the cores of the moment."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))


def numbered(df: DataFrame, name: str = "rid") -> DataFrame:
    """Add ``rid``, a number of the row that depends only on the order of the input's files.

    Joins inside an operator use it, so that rows with null or repeated ids stay apart. A scan gives the same numbers each
    time it runs, because its partitions and the order in them are fixed: also when executors come or go between two runs.
    """
    fixed_splits(df.sparkSession)
    return df.withColumn(name, F.monotonically_increasing_id())


def released(run):
    """``run`` over the batches of a task, then free memory goes back to the machine: workers are used again by later stages
    and would hold what their largest task took."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def lowered(text: Column) -> Column:
    """A-Z as a-z, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _bit(rid: np.ndarray, bits: int) -> np.ndarray:
    return (rid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def in_bitmap(hit: np.ndarray, bits: int, rid: np.ndarray) -> np.ndarray:
    """Whether a row may be in the set that ``bitmap_of`` was made from; never false for one that is."""
    return hit[_bit(rid, bits)]


def bitmap_of(rows: DataFrame, column: str, most_bits: int):
    """Broadcast bitmap of the hashes of a long column, of at most 2^most_bits bits, and its size in bits as a power of 2.

    It only spares work: what passes is joined exactly.
    """
    n = rows.count()
    bits = min(most_bits, max(14, int(8 * n).bit_length()))

    def mark(batches):
        out = np.zeros(1 << bits, bool)
        for batch in batches:
            out[_bit(batch[column].to_numpy(), bits)] = True
        where = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(where >> 12), pa.array(where & 4095)], ["block", "bit"])

    marks = rows.select(column).mapInArrow(mark, "block long, bit long").groupBy("block").agg(F.collect_set("bit").alias("bits"))
    full = np.zeros(1 << bits, bool)
    for row in marks.toLocalIterator():
        full[(row["block"] << 12) + np.array(row["bits"], np.int64)] = True
    return rows.sparkSession.sparkContext.broadcast(np.packbits(full).tobytes()), bits
