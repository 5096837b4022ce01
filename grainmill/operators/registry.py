"""Run registry: keys, job grids, shards, cells by recorded config, and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def spec_key(*parts) -> Column:
    return F.concat_ws("|", *parts)


def job_grid(settings: DataFrame, axes: list[str]) -> DataFrame:
    """All combinations of the values that the axes have in a table of settings, null left out; an axis' values are few and stand in one row."""
    out = settings.agg(*(F.collect_set(c).alias(c) for c in axes))
    for c in axes:
        out = out.withColumn(c, F.explode(c))
    return out


def shard_slice(df: DataFrame, order: list[str], shard: int, shards: int) -> DataFrame:
    """Every shards-th row of a job table, from the shard-th; job tables are small."""
    return df.withColumn("_r", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("_r") % shards == shard).drop("_r")


def cells_by_config(runs: DataFrame, defaults: dict, keys: list[str], value: str) -> DataFrame:
    """Runs grouped by recorded config, absent entries by their default, never by tag."""
    filled = runs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})
    return filled.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def mismatched(runs: DataFrame, tag: str, config: Column) -> DataFrame:
    """Runs whose tag says another config than they record."""
    return runs.filter(~F.col(tag).eqNullSafe(config))


def checked_cells(runs: DataFrame, keys: list[str], tag: str, config: Column) -> DataFrame:
    """runs, once no seed is given twice and no tag disagrees."""
    if (bad := duplicates(runs, keys).take(1)) or (bad := mismatched(runs, tag, config).take(1)):
        raise ValueError(f"registry is inconsistent: {bad[0].asDict()}")
    return runs


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha"))


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each path as same, changed, missing or new."""
    both = before.select("path", F.col("sha").alias("_a")).join(after.select("path", F.col("sha").alias("_b")), "path", "full")
    return both.select("path", F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed").otherwise("same").alias("state"))


def only_appended(old: str, new: str) -> bool:
    """Whether the old document's lines still occur in the new one, in order."""
    lines = iter(new.splitlines())
    return all(any(x == y for y in lines) for x in old.splitlines())


def unchanged_preset(blocks: dict[str, list[str]], cached: dict[str, list[str]], name: str) -> None:
    """Raises when a block's columns differ from the cached ones, order included."""
    if blocks.get(name) != cached.get(name):
        raise ValueError(f"block {name!r} has changed")


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return items.join(done, key, "left_anti")
