"""Relational operators over a checkpoint registry and model keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwind.operators.batching import global_row_number, least_before

#: In order of preference.
WEIGHTS = ("ema_state_dict", "ema_model_state_dict", "model_state_dict")
COMPILED = "._orig_mod."


def step_path(model: str, step: Column) -> Column:
    return F.format_string(f"{model}_step_%08d.pt", step)


def parsed_step(path: Column) -> Column:
    """The number behind the last underscore of a file name; null if there is none."""
    return F.regexp_extract(path, r"_(\d+)\.pt$", 1).try_cast("long")


def stale(registry: DataFrame, keep: int, step: str = "step") -> DataFrame:
    """All but the newest `keep` by step."""
    newest = registry.select(step).distinct().orderBy(F.col(step).desc()).limit(keep)
    return registry.join(F.broadcast(newest), step, "left_anti")


def latest(registry: DataFrame, path: str = "path", step: str = "step") -> DataFrame:
    return registry.agg(F.max_by(path, step).alias(path), F.max(step).alias(step))


def to_load(registry: DataFrame, explicit: str | None = None) -> DataFrame:
    """One row: the explicit path, else the best one, else the latest; step 0 and a null path if there is none."""
    best = F.max_by(F.when(F.col("is_best"), F.col("path")), F.when(F.col("is_best"), F.col("step")))
    return registry.agg(F.coalesce(F.lit(explicit), best, F.max_by("path", "step")).alias("path"), F.coalesce(F.max("step"), F.lit(0)).alias("step"))


def resume_state(registry: DataFrame) -> DataFrame:
    """One row: step, epoch and best_val of the newest checkpoint, with 0, 0 and infinity where there is none."""
    newest = lambda c, default: F.coalesce(F.max_by(c, "step"), F.lit(default)).alias(c)
    return registry.agg(newest("step", 0), newest("epoch", 0), newest("best_val", float("inf")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stale_remote(remote: DataFrame, local: DataFrame, model: str, path: str = "path") -> DataFrame:
    """Remote step files of the model that no local file has the name of; other files are never stale."""
    steps = remote.where(F.col(path).rlike(rf"^{model}_step_\d{{8}}\.pt$")).withColumn("_name", base_name(F.col(path)))
    return steps.join(local.select(base_name(F.col(path)).alias("_name")).distinct(), "_name", "left_anti").drop("_name")


def plain_key(key: Column) -> Column:
    """Without the mark of compiled modules."""
    return F.replace(key, F.lit(COMPILED), F.lit("."))


def reconciled_keys(source: DataFrame, target: DataFrame, key: str = "key") -> DataFrame:
    """The source's rows with their keys as the target spells them; own keys where the target has none."""
    spelled = target.select(F.col(key).alias("_target")).withColumn("_plain", plain_key(F.col("_target"))).groupBy("_plain").agg(F.min("_target").alias("_target"))
    joined = source.withColumn("_plain", plain_key(F.col(key))).join(spelled, "_plain", "left")
    return joined.withColumn(key, F.coalesce("_target", key)).drop("_plain", "_target")


def compatibility(model: DataFrame, loaded: DataFrame, key: str = "key", shape: str = "shape") -> DataFrame:
    """key and status: loaded, skipped (shapes differ; the model then misses it), unexpected or missing."""
    m = model.select(F.col(key), F.col(shape).alias("_model"))
    s = loaded.select(F.col(key), F.col(shape).alias("_loaded"))
    status = F.when(F.col("_model").isNull(), "unexpected").when(F.col("_loaded").isNull(), "missing").when(F.col("_model") == F.col("_loaded"), "loaded").otherwise("skipped")
    return m.join(s, key, "full_outer").select(key, status.alias("status"))


def parameter_count(keys: DataFrame, shape: str = "shape") -> DataFrame:
    size = F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)
    return keys.agg(F.sum(size).alias("parameters"))


def preferred_weights(available: DataFrame, by: str, name: str = "name", use_average: bool = True) -> DataFrame:
    """For each checkpoint the first of the preferred weights that it has, else `raw`."""
    order = WEIGHTS if use_average else WEIGHTS[-1:]
    ranks = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    return available.groupBy(by).agg(F.coalesce(F.min_by(name, F.element_at(ranks, F.col(name))), F.lit("raw")).alias("weights"))


def with_best(metrics: DataFrame, by: str, loss: str = "val_loss") -> DataFrame:
    """Adds best_before and is_new_best: strictly lower than all before, and positive."""
    valid = F.when(F.col(loss) > 0, F.col(loss))
    out = least_before(metrics, valid, by, "best_before")
    return out.withColumn("is_new_best", F.coalesce(valid < F.coalesce("best_before", F.lit(float("inf"))), F.lit(False)))


def saved_epochs(metrics: DataFrame, interval: int, by: str = "epoch", loss: str = "val_loss") -> DataFrame:
    """Epochs that are saved, with is_best. A best epoch between save epochs raises the bar without being saved."""
    return with_best(metrics, by, loss).where(F.col(by) % interval == 0).withColumn("is_best", F.col("is_new_best"))


def every_nth(saves: DataFrame, order: str, n: int) -> DataFrame:
    """Every n-th save is pushed."""
    return global_row_number(saves, order).where(F.col("n") % n == 0).drop("n")


def metric_tag(lang: Column, text: Column) -> Column:
    return F.concat(lang, F.lit("/"), F.replace(F.substring(text, 1, 20), F.lit(" "), F.lit("_")))


def model_card(config: dict | None, name: str) -> str:
    """Markdown about a model: its size from `model` in the configuration, with ? for what is missing, and the shapes of its data."""
    model = (config or {}).get("model", {})
    rows = [(k, model.get(k, "?")) for k in ("dim", "depth", "heads")]
    rows += [("vocab_size", model.get("vocab_size", 65)), ("sample_rate", f"{(config or {}).get('sample_rate', 24_000)} Hz"), ("mel_bins", (config or {}).get("n_mels", 100))]
    return "\n".join([f"# {name}", "", "| parameter | value |", "|---|---|", *(f"| {k} | {v} |" for k, v in rows), ""])
