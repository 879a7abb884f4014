"""Window operators: first rows per group, streaks, trends, sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; partitions are cut down to n rows per group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)


def trend(df: DataFrame, key: str, order: str, value: str, ranks: dict[str, int]) -> DataFrame:
    """prev and arrow per row: up, down or same by the rank of the value against the row before; none without a known one."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    table = F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])
    now, then = F.element_at(table, F.col(value)), F.element_at(table, F.col("prev"))
    arrow = F.when(now.isNull() | then.isNull(), "none").when(now > then, "up").when(now < then, "down").otherwise("same")
    return df.withColumn("prev", prev).withColumn("arrow", arrow)


def streaks(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """streak: how many rows in a row, this one included, have the same value."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    numbered = df.withColumn("_c", change).withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.withColumn("streak", F.row_number().over(Window.partitionBy(key, "_g").orderBy(order))).drop("_c", "_g")


def day_streaks(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, day, streak): consecutive days a key was seen; repeats on a day count once, a gap begins anew."""
    days = df.select(key, F.to_date(ts).alias("day")).filter("day IS NOT NULL").distinct()
    w = Window.partitionBy(key).orderBy("day")
    island = F.date_sub("day", F.row_number().over(w))
    return days.withColumn("_i", island).withColumn("streak", F.row_number().over(Window.partitionBy(key, "_i").orderBy("day"))).drop("_i")


def tail_drops(df: DataFrame, key: str, order: str, value: str, eps: float = 1e-9) -> DataFrame:
    """(key, drops): strict drops in a row at the end of each series."""
    w = Window.partitionBy(key).orderBy(order)
    steps = df.withColumn("_d", F.col(value) < F.lag(value).over(w) - eps).withColumn("_n", F.row_number().over(w))
    last = steps.groupBy(key).agg(F.max("_n").alias("n"), F.max(F.when(F.coalesce(F.col("_d"), F.lit(False)), None).otherwise(F.col("_n"))).alias("stop"))
    return last.select(key, (F.col("n") - F.col("stop")).alias("drops"))


def strikes(df: DataFrame, key: str, order: str, failed: str, limit: int = 3, days: int = 7) -> DataFrame:
    """(key, fails, last_fail, blocked): failures since the last success, and whether they still block at the end of the data."""
    end = df.agg(F.max(order).alias("now"))
    ok = df.filter(~F.col(failed)).groupBy(key).agg(F.max(order).alias("ok"))
    bad = df.filter(F.col(failed)).join(ok, key, "left").filter(F.col("ok").isNull() | (F.col(order) > F.col("ok")))
    counts = bad.groupBy(key).agg(F.count("*").alias("fails"), F.max(order).alias("last_fail"))
    return counts.join(F.broadcast(end)).select(key, "fails", "last_fail", ((F.col("fails") >= limit) & (F.col("now") - F.col("last_fail") < F.make_dt_interval(F.lit(days)))).alias("blocked"))


def seen_window(df: DataFrame, key: str, ts: str, days: int = 30) -> DataFrame:
    """(key, last_seen, active): the window counts from the last sighting, not the first."""
    end = df.agg(F.max(ts).alias("now"))
    last = df.groupBy(key).agg(F.max(ts).alias("last_seen"))
    return last.join(F.broadcast(end)).select(key, "last_seen", (F.col("last_seen") >= F.col("now") - F.make_dt_interval(F.lit(days))).alias("active"))


def debounce(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, n): bursts of events of a key without a pause of ``gap``; the last event of each would fire."""
    s = df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return s.select(key, "start", "end", "n")
