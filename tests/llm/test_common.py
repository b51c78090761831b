import pytest
from llm_helpers import clashing
from pyspark.sql import functions as F

from lexwind.llm.common import attach, join_by_frequency, pick


@pytest.mark.parametrize("most", [100, 0])
def test_attach_broadcast_and_salted(spark, most):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None, i % 2) for i in range(60)] + [(99, "alone", 0)], "i long, k string, m long")
    right = spark.createDataFrame([("hot", 0, "h0"), ("hot", 1, "h1"), (None, 0, "n0"), (None, 1, "n1")], "k string, m long, v string")
    got = {r.i: r.v for r in attach(left, right, ["k", "m"], most=most).collect()}
    assert got == {i: f"{'h' if i % 3 else 'n'}{i % 2}" for i in range(60)} | {99: None}
    assert attach(left, right, ["k", "m"], "inner", most=most).count() == 60


def test_join_by_frequency(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = join_by_frequency(left, right, "k", "n")
    assert out.columns == ["k", "id", "v"] and out.count() == 3000 and out.where("v != k * 2").count() == 0
    assert join_by_frequency(left.where("id < 0"), right.where("k < 0"), "k", "n").count() == 0


def test_pick_by_exact_name(spark):
    df = clashing(spark.createDataFrame([(1, "x", "y")], "doc_id long, text string, Text string"))
    assert pick(df, t="Text", u="text").first()[:] == ("y", "x")
