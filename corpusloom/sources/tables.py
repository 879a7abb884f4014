"""Parquet tables of one directory, and how their rows are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory (one file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows spread over all cores, where the scan would use less than half of them.

    A single small file is one task; costly per-row work must not run in it.  Large tables have
    more splits than cores and are left where they lie, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores, *by)
