"""Column helpers against Python's own."""

from mnemora.functions.columns import two_digits
from pyspark.sql import functions as F


def test_two_digits(spark):
    values = [n / 1000 for n in range(-2000, 2001)] + [0.994999, 0.995, 0.995001, 0.0049999, 1e-9, 0.0, 0.8749999999999999]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_digits(F.col("v")).alias("text")).collect()
    assert {r.v: r.text for r in rows} == {v: f"{v:.2f}" for v in values}
