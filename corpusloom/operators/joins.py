"""Joins Spark has no operator for: as-of, interval overlap, closures, title matches, index health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, value: Column, name: str) -> DataFrame:
    """left with the value of the last right row of its key strictly before ``at`` (null if none).

    Both sides meet in one sorted window per key instead of a range join: one shuffle, no pairs.
    """
    cols = left.columns
    lefts = left.select(*cols, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("_v"))
    rights = right.select(*[(F.col(key) if c == key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], F.col(right_at).alias("_t"), F.lit(1).alias("_side"), value.alias("_v"))
    # at equal positions the left row comes first, so that only earlier right rows count
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return lefts.unionByName(rights).withColumn(name, F.last("_v", ignorenulls=True).over(w)).filter("_side = 0").select(*cols, name)


def overlaps(a: DataFrame, b: DataFrame, key: str, cell: int) -> DataFrame:
    """Pairs of spans (start, end exclusive) of one key that overlap; touching spans don't.

    Spans are put into cells of a fixed width, so the join is on (key, cell) and each pair is kept in the first cell
    both touch only.
    """

    def cells(df: DataFrame, mark: str) -> DataFrame:
        out = df.select(key, *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c != key])
        return out.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(f"{mark}_start") / cell), F.floor((F.greatest(F.col(f"{mark}_end") - 1, F.col(f"{mark}_start"))) / cell))))

    j = cells(a, "a").join(cells(b, "b"), [key, "_cell"])
    first = F.floor(F.greatest("a_start", "b_start") / cell)
    return j.filter((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")) & (F.col("_cell") == first)).drop("_cell")


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions, once each, without loops."""
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def index_health(files: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, state): files not in the index and index entries without a file."""
    missing = files.select(key).distinct().join(index.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("unindexed"))
    stale = index.select(key).distinct().join(files.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("stale"))
    return missing.unionByName(stale)


def changed(rows: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): new, changed or removed against the known (key, digest)."""
    a, b = rows.select(key, F.col(digest).alias("_now")), known.select(key, F.col(digest).alias("_then"))
    j = a.join(b, key, "full_outer")
    kind = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed")
    return j.select(key, kind.alias("change")).filter("change IS NOT NULL")


def best_title(requests: DataFrame, titles: DataFrame) -> DataFrame:
    """(title, match, score): exact 100, stitched 95, synthesis 90 by normalised title; one match per request, the least title on a tie.

    Equal scores come from equi-joins on the derived keys, so no request meets every title.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))
    r = requests.select("title", norm(F.col("title")).alias("k"))
    t = titles.select(F.col("title").alias("match"), norm(F.col("title")).alias("m")).distinct()
    keys = t.select("match", F.explode(F.array(
        F.struct(F.col("m").alias("k"), F.lit(100).alias("score")),
        F.struct(F.when(F.col("m").endswith(" (stitched)"), F.expr("left(m, length(m) - 11)")).alias("k"), F.lit(95).alias("score")),
        F.struct(F.when(F.col("m").endswith(" (synthesis)"), F.expr("left(m, length(m) - 12)")).alias("k"), F.lit(90).alias("score")),
    )).alias("e")).select("match", "e.k", "e.score").filter("k IS NOT NULL AND k != ''")
    best = keys.groupBy("k").agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), F.col("match"))).alias("b"))
    return r.join(best, "k").select("title", "b.match", "b.score")


def ancestors(links: DataFrame, depth: int = 8) -> DataFrame:
    """(node, ancestor, distance) up to a bounded depth, in ``depth`` joins; a node met again ends its walk."""
    links = links.filter("parent IS NOT NULL").select("node", "parent")
    walk = links.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"), F.array("node", "parent").alias("seen"))
    out = walk
    up = links.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for k in range(2, depth + 1):
        walk = walk.join(up, "ancestor").filter(~F.array_contains("seen", F.col("next"))).select("node", F.col("next").alias("ancestor"), F.lit(k).alias("distance"), F.concat("seen", F.array("next")).alias("seen"))
        out = out.unionByName(walk)
    return out.select("node", "ancestor", "distance")
