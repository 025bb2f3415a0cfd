"""Tables as streams: one file, or a folder of files."""

from mnemora import session
from mnemora.streaming import flows


def test_table_of_one_file_and_of_many(spark, tmp_path):
    session.configure(spark)
    rows = spark.range(40).selectExpr("id", "cast(id AS string) AS text")
    rows.repartition(4).write.parquet(str(tmp_path / "many.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for table in ("many", "one"):
        got = flows.drain(flows.stream_table(spark, str(tmp_path), table, rows), "append")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
