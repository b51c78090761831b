"""Corpus ingest: column discovery, filters with reasons, counters, archive joins, speaker ids, unions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwind.exprs import trimmed
from lexwind.lexicon import TEXT_COLUMNS
from lexwind.lineage import cut
from lexwind.operators.batching import global_row_number


def text_column(df: DataFrame, candidates: Iterable[str] = TEXT_COLUMNS) -> str:
    """The first candidate that the table has."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"No text column among {', '.join(candidates)}; the table has: {', '.join(df.columns)}")


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def blank(text: Column) -> Column:
    return text.isNull() | (trimmed(text) == "")


def reject_reason(duration: Column, text: Column, has_audio: Column | None = None, shortest: float = 1.0, longest: float = 30.0) -> Column:
    """Why a sample isn't taken: no_audio (also if undecodable, so without a duration), empty_text, too_short, too_long."""
    missing = duration.isNull() if has_audio is None else ~F.coalesce(has_audio, F.lit(False)) | duration.isNull()
    return first_reason(("no_audio", missing), ("empty_text", blank(text)), ("too_short", duration < shortest), ("too_long", duration > longest))


def reject_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """One row: total, kept and a counter a reason."""
    names = ("no_audio", "empty_text", "too_short", "too_long")
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(reason).isNull()).alias("kept"), *[F.count_if(F.col(reason) == n).alias(n) for n in names])


def prepared(raw: Column, cleaned: Column, samples: Column, least_chars: int = 2, least_samples: int = 1024) -> Column:
    """Does a row pass preparation? Raw and cleaned text long enough, audio long enough; nulls fail."""
    return F.coalesce((F.length(trimmed(raw)) >= least_chars) & (F.length(cleaned) >= least_chars) & (samples >= least_samples), F.lit(False))


def clip_status(file: Column, raw: Column, cleaned: Column, found: Column, samples: Column, duration: Column, least_samples: int = 2048, shortest: float = 0.5, longest: float = 15.0) -> Column:
    """ok, failed (member or audio missing), filtered, or unnamed: without a file or raw text, so without a speaker id."""
    named = F.coalesce((file != "") & (F.length(trimmed(raw)) >= 2), F.lit(False))
    return (
        F.when(~named, F.lit("unnamed"))
        .when(F.coalesce(F.length(cleaned) < 2, F.lit(True)), F.lit("filtered"))
        .when(~F.coalesce(found, F.lit(False)) | samples.isNull(), F.lit("failed"))
        .when((samples < least_samples) | (duration < shortest) | (duration > longest), F.lit("filtered"))
        .otherwise(F.lit("ok"))
    )


def status_counts(df: DataFrame, status: str = "status", speaker: str = "client_id") -> DataFrame:
    """processed, failed, and the speakers of all named rows, also of those that are filtered later."""
    return df.agg(
        F.count_if(F.col(status) == "ok").alias("processed"), F.count_if(F.col(status) == "failed").alias("failed"),
        F.count_distinct(F.when(F.col(status) != "unnamed", F.coalesce(F.col(speaker), F.lit("unknown")))).alias("speakers"),
    )


def require_rows(df: DataFrame, message: str = "No sample is left after filtering") -> DataFrame:
    """The table itself, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def usable_audio(samples: Column, sample_rate: int = 24_000, shortest: float = 1.0) -> Column:
    """Finite everywhere and long enough."""
    finite = F.forall(samples, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return finite & (F.size(samples) >= int(shortest * sample_rate))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def violations(*rules: tuple[str, Column]) -> Column:
    """Names of all rules whose condition holds, or can't be decided."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]))


def request_violations() -> Column:
    """Checks of a synthesis request's columns: text, n_steps, cfg_strength, speed, duration (may be null), max_chars, pause."""
    c = F.col
    return violations(
        ("text", blank(c("text"))), ("n_steps", c("n_steps") < 1), ("cfg_strength", c("cfg_strength") < 0), ("speed", c("speed") <= 0),
        ("duration", F.coalesce(c("duration") <= 0, F.lit(False))), ("max_chars", c("max_chars") < 0), ("pause", c("pause") < 0),
    )


def sampler_violations(most: int = 65_536) -> Column:
    """Checks of a sampling request: cond_len, lens, duration."""
    c = F.col
    return violations(("lens", (c("lens") < 1) | (c("lens") > c("cond_len"))), ("duration", (c("duration") < 1) | (c("duration") > most)))


def dense_ids_by_appearance(df: DataFrame, key: str, order: str, out: str = "speaker_id", missing: str = "unknown") -> DataFrame:
    """0, 1, ... to the keys in order of first appearance; null keys count as one key. `order` is unique.

    Only the distinct keys are numbered, by ranges; the rows meet their number in a join.
    """
    named = df.withColumn("_key", F.coalesce(F.col(key), F.lit(missing)))
    first = named.groupBy("_key").agg(F.min(order).alias("_first"))
    ranked = global_row_number(first, "_first").select("_key", (F.col("n") - 1).alias(out))
    return named.join(ranked, "_key").drop("_key")


def join_members(rows: DataFrame, members: DataFrame, file: str = "path", prefixes: Iterable[str | Column] = ("clips/",), by: tuple[str, ...] = ()) -> DataFrame:
    """Left join of metadata rows with archive members (ordinal, name), adding member and ordinal; null where none fits.

    The first prefix that the reader tries decides: the exact name prefix + file, else the first member in archive
    order whose name ends with the file's name; later prefixes matter only if that finds nothing, which a further
    exact name may still do. The suffix match runs as an equi-join on the names' last `n` characters for each length n
    of a file name that the exact join has left over, so no rows are compared all against all. `by` names columns of both sides,
    such as the archive, that must agree.
    """
    keyed = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    names = members.groupBy(*by, "name").agg(F.min("ordinal").alias("ordinal"))
    first = next(iter(prefixes))
    wanted = keyed.withColumn("_exact", F.concat(F.lit(first) if isinstance(first, str) else first, F.col(file)))
    exact = wanted.join(names.select(*by, F.col("name").alias("_exact"), F.col("ordinal").alias("_at")), [*by, "_exact"], "left")
    left = exact.where("_at is null").select("_row", *by, F.col(file).alias("_file")).where("_file is not null and _file != ''")
    lengths = left.select(F.length("_file").alias("_n")).distinct()
    ends = names.join(F.broadcast(lengths), F.length("name") >= F.col("_n")).select(*by, F.substring("name", F.length("name") - F.col("_n") + 1, F.col("_n")).alias("_file"), "name", "ordinal")
    ends = ends.groupBy(*by, "_file").agg(F.min_by("name", "ordinal").alias("_suffix"), F.min("ordinal").alias("_suffix_at"))
    found = exact.join(left.join(ends, [*by, "_file"]).select("_row", "_suffix", "_suffix_at"), "_row", "left")
    member, ordinal = F.coalesce(F.when(F.col("_at").isNotNull(), F.col("_exact")), "_suffix"), F.coalesce("_at", "_suffix_at")
    return found.select(*rows.columns, member.alias("member"), ordinal.alias("ordinal"))


def zip_by_position(left: DataFrame, right: DataFrame, index: str = "idx", strict: bool = False) -> DataFrame:
    """Rows with equal positions; what one side lacks is left out, or is an error if `strict`."""
    if not strict:
        return left.join(right, index)
    both = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), index, "full_outer")
    whole = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    message = F.concat(F.lit("Only one side has position "), F.col(index).cast("string"))
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("_left", "_right")


def union_sources(sources: Iterable[tuple[int, Callable[[], DataFrame]]]) -> tuple[DataFrame | None, list[str]]:
    """Union by name of (speaker id, loader) sources. One that fails is skipped; its error is returned.

    A source is tried by reading its first row, so one that can be planned but not read is skipped too. What is damaged further on
    shows only when the union is read, and then as an error: rows are not left out silently.
    """
    loaded, errors = [], []
    for speaker, load in sources:
        try:
            rows = load().withColumn("speaker_id", F.lit(speaker))
            rows.take(1)
            loaded.append(rows)
        except Exception as e:  # noqa: BLE001  any failure of one source leaves the others
            errors.append(str(e))
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), loaded) if loaded else None), errors


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n rows by order; 0 or None keeps all."""
    return df.orderBy(order).limit(n) if n else df
