"""Sinks over plain Parquet folders: upsert, delete, append, retention, migrations; each replaces a folder at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last by the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))).filter("_n = 1").drop("_n")


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The table with the rows in place of those of their keys.  Of several rows of one key the last by ``order`` holds, and on a
    tie, or without an order, the greatest by its values."""
    values = F.struct(*([F.col(order)] if order else []), *[F.to_json(F.struct(c)) for c in sorted(rows.columns) if c != key])
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), values).alias("_r")).select("_r.*")
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(last)


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def replace(spark: SparkSession, path: str, df: DataFrame) -> None:
    """Writes beside the folder, then swaps, so that a reader never sees half a table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    new, old, at = hadoop(path + ".new"), hadoop(path + ".old"), hadoop(path)
    df.write.mode("overwrite").parquet(path + ".new")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def prune(tables: dict[str, tuple[DataFrame, str]], cutoff: Column) -> dict[str, DataFrame]:
    """Each table (rows, time column) without what is older than the cutoff; no cascade."""
    return {name: df.filter(F.col(ts).isNull() | (F.col(ts) >= cutoff)) for name, (df, ts) in tables.items()}


def migrate(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]], done: list[str]) -> tuple[DataFrame, list[str]]:
    """The DataFrame after the steps that aren't done yet, in order, and the names that are done then."""
    done = list(done)
    for name, step in steps:
        if name not in done:
            df, done = step(df), [*done, name]
    return df, done


def cached_embeddings(keys: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all, new): (cache_key, embedding) of the keys, computing only those the cache lacks; ``new`` is to be appended."""
    have = keys.join(cache.filter(F.col("embedding").isNotNull()).dropDuplicates(["cache_key"]), "cache_key").select("cache_key", "embedding")
    missing = embed(keys.join(have.select("cache_key"), "cache_key", "left_anti")).select("cache_key", "embedding")
    return have.unionByName(missing), missing
