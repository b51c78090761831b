"""Queries over small tables are read by Spark's tasks."""

from lexwind.plans.queries import QUERIES


def test_lists_stay_with_spark(spark):
    plan = QUERIES["rows_of_lists"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "LocalRelation" not in plan and "audio_path" in plan
