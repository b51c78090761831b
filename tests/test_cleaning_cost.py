"""Cheap tests stand before the dear ones when texts are cleaned."""

from pyspark.sql import functions as F

from lexwind.functions.text import COMPOSED, KEPT, compose_kept, drop_other_characters


def plan_of(spark, made) -> str:
    return spark.createDataFrame([("a",)], "raw string").select(made(F.col("raw")))._jdf.queryExecution().optimizedPlan().toString()


def test_composed_texts_skip_the_long_classes(spark):
    assert f"[^{COMPOSED}]" in plan_of(spark, compose_kept)


def test_ascii_letters_go_first(spark):
    assert "[A-Za-z]+" in plan_of(spark, drop_other_characters)
    raw = ["", "abc", "Hello, Сайн XYZ байна! [ok]^_`{z} éà ٣ 中 қ", "\n\tA\x00b 7 (9)", None, "z" * 500 + "ө" + "Z" * 500]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", drop_other_characters(F.col("raw")).alias("x"))
    assert {r.i: r.x for r in rows.collect()} == {i: x if x is None else "".join(c for c in x if c in KEPT) for i, x in enumerate(raw)}
