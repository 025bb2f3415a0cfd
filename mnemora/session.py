"""Session settings and the few helpers that touch the Spark runtime."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    for key, value in CONF.items():
        spark.conf.set(key, value)
    return spark


#: Row groups of stored tables: Spark's reader holds one as a whole where it has few rows, so its size is looked at from the first row on.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate data goes: ``spark.checkpoint.dir``, or a folder beside the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``; without one, beside the warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, path: str | None = None, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table ``name`` below ``path``, or in a folder of its own in the shared one, in folders ``by`` these
    columns: computed once, safe from lost executors, and of a size that Spark knows when it plans. Rows may be large."""
    spark = df.sparkSession
    target = f"{path or shared_folder(spark).rstrip('/') + '/' + uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").options(**ROW_GROUPS).partitionBy(*(by or [])).parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def take_bounded(df: DataFrame, bound: int):
    """Rows of ``df`` when there are at most ``bound``, else None. Never moves more than bound + 1 rows."""
    rows = df.limit(bound + 1).toArrow()
    return rows if rows.num_rows <= bound else None
