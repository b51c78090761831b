"""K-d tree partitioning into shards of near-equal bytes (operator 9).

A tree of `log2(shards)` levels is built over the documents' metadata: source, language and size. Each node is split
along the dimension in which it is widest (its range over the root's range) at the weighted median of the bytes, so
that the halves weigh the same and after the last level every leaf holds its target of bytes.

Coordinates are whole numbers of 52 bits: 20 bits of the position along the dimension, then 32 bits of the group's hash,
so that a source with a third of all rows can be cut inside. Sources and languages stand at their rank among the
distinct values, so names that begin alike are told apart. Medians are found on counts: a histogram of 2**18 cells a node
at most is summed and refined 18 bits at a time. The nodes are a table of one row each (fewer than there are shards), which
is all that is broadcast; neither cells nor rows reach the driver, and plans don't grow with the number of shards.

Equal texts form a group and share a shard, unless the group weighs more than a quarter of a leaf; such a group is
dealt document by document, so that it can't unbalance the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import KEYS, attach, cut, join_by_frequency, one_of_each, pick, positional, row_keys
from lexwind.operators.batching import global_row_number

#: Of source, lang and size: bits of position, bits of hash below them; and bits a pass of the median search settles.
POSITION_BITS, HASH_BITS, STEP_BITS = 20, 32, 18
DIMENSIONS = ("x_source", "x_lang", "x_size")


def with_rank(table: DataFrame, rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of the column's value among its distinct values in `rows` in code point order, from 1; null is 0."""
    distinct = rows.where(F.col(column).isNotNull()).select(column).distinct()
    ranks = cut(global_row_number(distinct, column).select(column, F.col("n").alias(out)))
    return attach(table, ranks, [column]).withColumn(out, F.coalesce(out, F.lit(0)).cast("double"))


def scaled(c: str, low: float, high: float) -> Column:
    """Position in POSITION_BITS bits, followed by the hash."""
    span = high - low
    cells = float((1 << POSITION_BITS) - 1)
    position = F.floor((F.col(c) - F.lit(low)) / F.lit(span) * F.lit(cells)).cast("long") if span > 0 else F.lit(0).cast("long")
    return F.shiftleft(position, HASH_BITS) + F.col("h")


def medians(line: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its cut: points up to and including it make up half of the node's weight, as near as may be.

    line: node, at (the coordinate along the node's dimension), w. nodes: node, total (its weight).
    """
    bits = POSITION_BITS + HASH_BITS
    state = nodes.select("node", "total", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    while bits > 0:
        step = min(STEP_BITS, bits)
        cell = F.shiftright("at", bits - step).alias("cell")
        inside = line.join(F.broadcast(state.select("node", "total", "prefix", "below")), "node").where(F.shiftright("at", bits) == F.col("prefix"))
        sums = inside.groupBy("node", "total", "below", cell).agg(F.sum("w").alias("w"))
        cells = sums.groupBy("node", "total", "below").agg(F.array_sort(F.collect_list(F.struct("cell", "w"))).alias("cells"))  # at most 2**step
        reached = F.aggregate(
            "cells", F.struct(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("w"), F.col("below").alias("before"), F.col("below").alias("sum")),
            lambda acc, x: F.when(2 * acc["sum"] >= F.col("total"), acc).otherwise(F.struct(x["cell"].alias("cell"), x["w"].alias("w"), acc["sum"].alias("before"), (acc["sum"] + x["w"]).alias("sum"))))
        state = cut(cells.select("node", "total", reached.alias("r")).select("node", "total", F.col("r.cell").alias("prefix"), F.col("r.before").alias("below"), F.col("r.w").alias("w")))
        bits -= step
    over, under = 2 * (F.col("below") + F.col("w")) - F.col("total"), F.col("total") - 2 * F.col("below")
    return state.select("node", F.when(over <= under, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def assign_leaves(points: DataFrame, levels: int) -> DataFrame:
    """Adds node: the leaf's number, 0 to 2**levels - 1."""
    if not levels:
        return points.withColumn("node", F.lit(0))
    ends = points.agg(*[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("low", F.min), ("high", F.max))]).first()
    if ends[f"low_{DIMENSIONS[0]}"] is None:
        return points.withColumn("node", F.lit(0))
    points = cut(points.select("g", "w", *[scaled(d, ends[f"low_{d}"], ends[f"high_{d}"]).alias(d) for d in DIMENSIONS], F.lit(1).alias("node")))
    for _ in range(levels):
        width = {d: F.max(F.shiftright(d, HASH_BITS)) - F.min(F.shiftright(d, HASH_BITS)) for d in DIMENSIONS}
        nodes = points.groupBy("node").agg(F.sum("w").alias("total"), F.array(*width.values()).alias("widths"))
        nodes = cut(nodes.select("node", "total", F.array_position("widths", F.array_max("widths")).cast("int").alias("widest")))
        line = points.join(F.broadcast(nodes.select("node", "widest")), "node").select("node", F.element_at(F.array(*DIMENSIONS), F.col("widest")).alias("at"), "w")
        met = points.join(F.broadcast(medians(line, nodes.select("node", "total"))), "node").join(F.broadcast(nodes.select("node", "widest")), "node")
        right = F.element_at(F.array(*DIMENSIONS), F.col("widest")) > F.col("cut")
        points = cut(met.select("g", "w", *DIMENSIONS, (2 * F.col("node") + right.cast("int")).alias("node")))
    return points.withColumn("node", F.col("node") - (1 << levels))


def placed_rows(rows: DataFrame, levels: int) -> DataFrame:
    """The columns of `rows` but for text, lang and source, with size, text_crc32 and shard. rows: doc_id, text, lang, source and more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    kept = [c for c in rows.columns if c not in ("text", "lang", "source")]
    table = rows.select(*kept, "lang", "source", size.alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("equal"), F.log2(size).alias("x_size"))
    table = cut(with_rank(with_rank(table, rows, "lang", "x_lang"), rows, "source", "x_source").drop("lang", "source"))
    kept += ["size", "text_crc32"]
    total = table.agg(F.sum("size")).first()[0] or 0
    heavy = F.col("w") > total / (4 << levels)
    groups = table.groupBy("equal").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("x_lang").alias("x_lang"), F.min("x_source").alias("x_source"), F.min("x_size").alias("x_size"))
    groups = cut(groups.withColumn("heavy", heavy))
    # By counting, fewer than 4 * shards groups weigh more than a quarter of a leaf.
    whales = groups.where("heavy").select("equal", F.lit(True).alias("dealt"))
    table = table.join(F.broadcast(whales), "equal", "left").withColumn(
        "g", F.when(F.col("dealt"), F.xxhash64("equal", "doc_id", "x_source", "x_lang")).otherwise(F.col("equal")))
    h = F.col("g").bitwiseAND((1 << HASH_BITS) - 1).alias("h")
    whole = groups.where("not heavy").select(F.col("equal").alias("g"), "w", "n", *DIMENSIONS, h)
    apart = table.where("dealt").groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n"), *[F.min(d).alias(d) for d in DIMENSIONS]).withColumn("h", h)
    points = whole.unionByName(apart.select(whole.columns))
    leaves = assign_leaves(cut(points), levels)
    counted = cut(leaves.select("g", F.col("node").cast("int").alias("shard"))).join(points.select("g", "n"), "g")
    return join_by_frequency(table.select(*kept, "g"), counted, "g", "n").select(*kept, "shard")


def kd_shards(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", levels: int = 4, target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard (0 to 2**levels - 1) and slot (gapless from 0 in its shard).

    size is the UTF-8 bytes of the text plus 1; a null text has none. Null languages and sources stand first along
    their dimension, null ids first within a shard. Repeated rows and equal texts get slots of their own; texts of any
    length count whole; extra columns do no harm. An empty table gives no rows; with fewer groups than shards some
    shards stay empty. With `target_bytes`, `levels` is the least number of splits after which an even leaf holds at most
    so many bytes.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col, source=source_col)
    return slots(placed_rows(rows, levels if target_bytes is None else levels_for(rows, target_bytes)))


def levels_for(rows: DataFrame, target_bytes: int) -> int:
    """How often everything is halved until a leaf has the target size. Splits are at weighted medians, so all leaves get there together."""
    total = rows.agg(F.sum(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1)).first()[0] or 0
    levels = 0
    while total > target_bytes << levels:
        levels += 1
    return levels


def slots(placed: DataFrame) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, without gathering a shard in one task.

    Rows are ordered by range over all tasks and stored; each task's first slot in a shard follows from the counts of
    the tasks before it (one row a task and shard).
    """
    spark = placed.sparkSession
    order = ["shard", "doc_id", "text_crc32", "size", *(c for c in placed.columns if c in KEYS)]
    ordered = cut(placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    numbered = ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("task", F.shiftright("at", 33))
    runs = cut(numbered.groupBy("shard", "task").agg(F.min("at").alias("first_at"), F.count("*").alias("n")))
    before = runs.select("shard", "task", "first_at", (F.sum("n").over(Window.partitionBy("shard").orderBy("task")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), ["shard", "task"]).select(*placed.columns, (F.col("before") + F.col("at") - F.col("first_at")).alias("slot"))


def write_shards(
    docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", levels: int = 4, target_bytes: int | None = None, salts: int = 16,
) -> None:
    """Write whole documents into one folder a shard (shard=0, shard=1, ...), many files a shard, by slot order within each.

    Every row of `docs` is written once. Rows meet their places by a hash of the whole row; of equal rows one stands for
    all, and the places of frequent ones are dealt over salts. A column of `docs` that is called shard or slot in any case is
    written as _shard or _slot. An empty table writes no shard.
    """
    flat = positional(docs)
    at = {new: F.col(f"_c{docs.columns.index(c)}").alias(new) for new, c in (("doc_id", id_col), ("text", text_col), ("lang", lang_col), ("source", source_col))}
    keyed = flat.select("*", *row_keys(flat))
    if target_bytes is not None:
        levels = levels_for(keyed.select(at["text"]), target_bytes)
    places = cut(slots(placed_rows(keyed.select(*KEYS, *at.values()), levels)).select(*KEYS, "shard", "slot"))
    counts = cut(places.groupBy(*KEYS).agg(F.count("*").alias("n")))
    whole = one_of_each(keyed, counts.withColumn("_salts", F.least(F.lit(salts).cast("long"), F.col("n"))))
    # Of n equal rows the places are dealt over as many copies of the row, up to `salts`.
    whole = whole.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    dealt = places.join(counts, KEYS).withColumn("_salt", F.pmod(F.xxhash64("shard", "slot"), F.least(F.lit(salts).cast("long"), F.col("n")))).drop("n")
    names = [f"_{c}" if c.lower() in ("shard", "slot") else c for c in docs.columns]
    rows = dealt.join(whole, [*KEYS, "_salt"]).select(*flat.columns, "shard", "slot").toDF(*names, "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
