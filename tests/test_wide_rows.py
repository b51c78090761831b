"""Rows with samples, features or files meet others in shuffles, and are made in many tasks."""

from lexwind.operators.batching import spread
from lexwind.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_clips_are_not_broadcast(spark):
    made = QUERIES["cleaned_clips"](spark, SMALL)
    plan = plan_of(made)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert "samples" not in "".join(line for line in plan.splitlines() if "Exchange" in line and "idx" in line)
    assert {r["status"] for r in made.select("status").collect()} == {"ok", "failed", "filtered", "unnamed"}


def test_training_rows_are_not_broadcast(spark):
    plan = plan_of(QUERIES["training_table"](spark, SMALL))
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "SortMergeJoin" in joins[0] and "mel" not in "".join(line for line in plan.splitlines() if "BroadcastExchange" in line)


def test_tones_are_made_behind_the_shuffle(spark):
    """Keys are dealt, not the arrays made of them; tasks grow with the keys."""
    plan = plan_of(QUERIES["audio_features"](spark, SMALL))
    dealt = plan[plan.index("REPARTITION_BY_NUM"):]
    assert "transform(" not in dealt and "SIN(" in plan
    assert spread(spark.range(50_000), "id").rdd.getNumPartitions() == 49
    assert spread(spark.range(10), "id").rdd.getNumPartitions() == 8
