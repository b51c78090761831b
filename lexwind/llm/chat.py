"""Chat formatting in budgeted windows (operator 5, native).

Turns are marked as `<turn ROLE>TEXT</turn>` and a line feed; `&`, `<` and `>` inside roles and texts are written as
`&amp;`, `&lt;` and `&gt;`, so no text can close a turn and every text can be read back.

Prefix sums of the turns' tokens choose the windows. The room is what the system turn and the history leave over in the
budget. A turn over half of it has a window of its own; the others are cut by a grid as wide as the room less the
conversation's largest such turn, and a turn belongs to the cell in which it starts, so that windows are cut between
turns only and stay within the budget. Every window repeats the system turn and, after it, the last turns of the window
before as far as the history budget reaches. The repeated turns are masked: only an assistant turn's first appearance is
a target of the loss.

Tokens are counted as the bytes of the formatted turn, which is the most that any byte-level vocabulary can make of it, so
a window never has more tokens than the budget, whatever the vocabulary. The one exception can't be cut between turns: a
turn that is larger than the room alone. Its window is whole and flagged as `over_budget`.

Everything is window functions over one conversation's turns, and what is gathered is one window's turns at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexwind.llm.common import pick


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def most_tokens(formatted: Column) -> Column:
    """Bytes, since a token of a byte-level vocabulary stands for at least one."""
    return F.octet_length(formatted).cast("long")


def format_chat(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    budget: int = 3072, history: int = 384, target_role: str = "assistant", system_role: str = "system",
) -> DataFrame:
    """One row per window: conv_id, window_id (gapless from 0), n_repeated (its leading repeated turns), formatted, loss_spans, over_budget.

    loss_spans are (start, end) code points in `formatted`, end exclusive. The system turn is a conversation's first
    turn if that has the system role. Null texts and roles count as empty; rows go by turn (nulls first), then role
    and text; repeated rows are turns of their own; rows with a null conversation form one; extra columns do no harm.
    Empty tables give no rows. A system turn that leaves no room is still repeated, and windows then hold one turn each;
    these and very long turns make windows over the budget, which `over_budget` tells.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    marked = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"), escaped(F.col("text")), F.lit("</turn>\n"))
    rows = rows.select("conv_id", "turn", "role", "text", marked.alias("out")).withColumn("tokens", most_tokens(F.col("out")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(order))
    is_system = (F.col("nth") == 1) & (F.col("role") == system_role)
    by_turn = Window.partitionBy("conv_id").orderBy("nth")
    rows = rows.withColumns({
        "system_tokens": F.first(F.when(is_system, F.col("tokens")).otherwise(0)).over(by_turn),
        "start": F.coalesce(F.sum(F.when(is_system, 0).otherwise(F.col("tokens"))).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "is_system": is_system,
    })
    rows = rows.withColumn("room", F.greatest(F.lit(2).cast("long"), F.lit(budget - history) - F.col("system_tokens")))
    rows = rows.withColumn("large", 2 * F.col("tokens") > F.col("room"))
    largest = F.max(F.when(~F.col("large") & ~F.col("is_system"), F.col("tokens"))).over(Window.partitionBy("conv_id"))
    # A large turn opens a window and so does the turn after it; else the grid decides.
    rows = rows.withColumn("cell", F.floor(F.col("start") / (F.col("room") - F.coalesce(largest, F.lit(0)))))
    opens = (F.col("nth") > 1) & ~F.lag("is_system", 1, False).over(by_turn) & ((F.lag("cell").over(by_turn) != F.col("cell")) | F.col("large") | F.lag("large").over(by_turn))
    rows = rows.withColumn("opens", F.when(opens, 1).otherwise(0)).withColumn("window_id", F.sum("opens").over(by_turn))
    # Tokens from this turn to the end of its window: within the history budget it is repeated in the next window.
    in_window = Window.partitionBy("conv_id", "window_id").orderBy("nth")
    rows = rows.withColumns({
        "to_end": F.sum("tokens").over(in_window.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "last": F.max("window_id").over(Window.partitionBy("conv_id")),
        "system_out": F.first(F.when(F.col("is_system"), F.col("out"))).over(by_turn),
        "leads": F.row_number().over(in_window) == 1,
    })
    again = ~F.col("is_system") & (F.col("to_end") <= history) & (F.col("window_id") < F.col("last"))
    places = F.array_compact(F.array(
        F.struct(F.col("window_id").alias("window_id"), F.lit(1).alias("kind")),
        F.when(again, F.struct((F.col("window_id") + 1).alias("window_id"), F.lit(0).alias("kind"))),
    ))
    system = F.when(F.col("leads") & (F.col("window_id") > 0), F.col("system_out"))
    placed = rows.select("conv_id", "nth", "out", "role", system.alias("system_out"), F.explode(places).alias("at")).select(
        "conv_id", "at.window_id", "at.kind", "nth", "out", F.when(F.col("at.kind") == 1, F.col("system_out")).alias("system_out"),
        ((F.col("at.kind") == 1) & (F.col("role") == target_role)).alias("target"), F.length(escaped(F.col("role"))).alias("role_chars"))
    grouped = placed.groupBy("conv_id", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", "out", "target", "role_chars"))).alias("turns"),
        F.max("system_out").alias("system_out"), F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("n_history"))
    grouped = grouped.withColumn("prefix", F.coalesce("system_out", F.lit("")))
    spans = F.aggregate(
        "turns", F.struct(F.length("prefix").alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["out"])).alias("at"),
            F.when(t["target"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + t["role_chars"] + len("<turn >")).cast("int").alias("start"), (acc["at"] + F.length(t["out"]) - len("</turn>\n")).cast("int").alias("end")))))
            .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return grouped.select(
        "conv_id", "window_id", (F.col("n_history") + F.col("system_out").isNotNull().cast("int")).cast("long").alias("n_repeated"),
        F.concat("prefix", F.array_join(F.transform("turns", lambda t: t["out"]), "")).alias("formatted"), spans.alias("loss_spans")
    ).withColumn("over_budget", F.octet_length("formatted") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted windows alone: conv_id, turns (role, text, in order), loss_text, formatted_chars."""
    pieces = F.slice(F.split("formatted", "</turn>\n"), F.col("n_repeated").cast("int") + 1, F.greatest(F.lit(0), F.size(F.split("formatted", "</turn>\n")) - 1 - F.col("n_repeated").cast("int")))
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.regexp_extract(p, r"^<turn ([^>]*)>", 1)).alias("role"), unescaped(F.regexp_replace(p, r"^<turn [^>]*>", "")).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    own = windows.select("conv_id", "window_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window_id", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
