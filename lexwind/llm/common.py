"""Plumbing shared by the training-data operators: column picking, row keys and skew-proof joins."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexwind.lineage import cut, ensure_checkpoint_dir

__all__ = ["KEYS", "attach", "cut", "ensure_checkpoint_dir", "join_by_frequency", "one_of_each", "pick", "positional", "release", "repeated", "row_keys", "text_batches"]

#: Names of the two hashes of a whole row; together they tell all rows of a table apart.
KEYS = ["_k1", "_k2"]


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns by exact name, renamed to the keywords.

    Positions are resolved first, so other columns whose names clash (also by letter case only) do no harm.
    """
    at = {new: df.columns.index(name) for new, name in wanted.items()}
    flat = positional(df)
    return flat.select(*[F.col(f"_c{i}").alias(new) for new, i in at.items()])


def positional(df: DataFrame) -> DataFrame:
    """The same table with columns named _c0, _c1, ..."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


def hashable(df: DataFrame) -> list[Column]:
    """The columns; those that hold maps or variants as JSON, since Spark has no hash for them."""
    return [F.to_json(F.struct(f.name)) if re.search("map<|variant", f.dataType.simpleString()) else F.col(f.name) for f in df.schema]


def row_keys(df: DataFrame) -> list[Column]:
    """KEYS of every row: equal rows have equal keys, others don't (128 bits)."""
    values = hashable(df)
    return [F.xxhash64(*values).alias(KEYS[0]), F.xxhash64(F.lit(1), *values).alias(KEYS[1])]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects the plans that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_batches(spark: SparkSession, most: int = 1_000) -> None:
    """Hold at most so many rows in an Arrow batch from now on: whole texts are long, and a batch lies in memory on both sides.

    Spark reads the setting when a plan runs, which is after the operator has returned, so it stays lowered in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def same(keys: Iterable[str], left: DataFrame, right: DataFrame, prefix: str) -> Column:
    """Null-safe equality of the keys; the right side's are named with the prefix."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[prefix + k])
    return cond


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", most: int = 50_000, salts: int = 16) -> DataFrame:
    """Join a table that has one row a group; `keys` compare null-safely.

    Up to `most` groups (counted here) the table is broadcast. Beyond, every group's row is repeated for `salts`
    salts and the left rows are dealt over them, so that a group with a third of all rows meets `salts` tasks.
    Salts come from a row's contents and its partition, so a task that runs again deals alike and equal rows part.
    """
    small = right.toDF(*[f"_r_{c}" if c in keys else c for c in right.columns])
    if right.limit(most + 1).count() <= most:
        joined = left.join(F.broadcast(small), same(keys, left, small, "_r_"), how)
    else:
        small = small.withColumn("_r__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        left = left.withColumn("_salt", F.pmod(F.xxhash64(*hashable(left), F.spark_partition_id()), F.lit(salts)).cast("int"))
        joined = left.join(small, same([*keys, "_salt"], left, small, "_r_"), how).drop("_salt", "_r__salt")
    return joined.drop(*[f"_r_{k}" for k in keys])


def parted(right: DataFrame, weight: str, share: int) -> tuple[DataFrame, DataFrame]:
    """The keys with more than 1/`share` of all that `weight` counts, fewer than `share` by counting, and the others."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    return right.where(F.col(weight) * share > total), right.where(F.col(weight) * share <= total)


def join_by_frequency(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join on a key that is unique on the right, where `weight` counts its rows on the left.

    Frequent keys are broadcast, as they are few by counting; the rest meet in a shuffled join in which no key is frequent.
    """
    keys = [key] if isinstance(key, str) else key
    hot, cold = (x.drop(weight) for x in parted(right, weight, share))
    frequent = left.join(F.broadcast(hot), keys)
    rare = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return frequent.unionByName(rare)


def one_of_each(rows: DataFrame, chosen: DataFrame, weight: str = "n", share: int = 1000) -> DataFrame:
    """One row for each of the chosen KEYS: the columns of `rows` and of `chosen`.

    `chosen` has unique KEYS and in `weight` how many (equal) rows have them. Frequent keys are broadcast and their rows
    reduced before the shuffle; the others meet in a shuffled join that no key is frequent in.
    """
    held = [c for c in rows.columns if c not in KEYS]
    more = [c for c in chosen.columns if c not in (*KEYS, weight)]
    hot, cold = parted(chosen, weight, share)

    def reduced(df: DataFrame) -> DataFrame:
        one = df.groupBy(*KEYS).agg(F.first(F.struct(*held)).alias("_row"), *[F.first(c).alias(c) for c in more])
        return one.select(*KEYS, "_row.*", *more)

    frequent = reduced(rows.join(F.broadcast(hot), KEYS))
    rare = reduced(rows.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti").join(cold, KEYS))
    return frequent.unionByName(rare)


def repeated(rows: DataFrame, times: str, block: int = 1_000) -> DataFrame:
    """Each row as often as the column `times` says; none for 0.

    A row with over `block` copies to come is first dealt over the tasks in shares of at most `block`, so that no task makes
    the copies of a large group alone.
    """
    n = F.col(times)
    rows = rows.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / F.lit(block)) - 1, F.lit(0)).cast("long")))).where(n > 0)
    few, many = rows.where(n <= block), rows.where(n > block)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = few.unionByName(many.repartition(parts, "_share", *[c for c in KEYS if c in rows.columns]))
    own = F.least(F.lit(block), n - F.col("_share") * block).cast("int")
    return dealt.withColumn("_again", F.explode(F.sequence(F.lit(1), own))).drop("_share", "_again")
