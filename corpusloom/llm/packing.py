"""Filling fixed-capacity containers with items (problem 9).

Method: bound-certified repacking.  Items are spread over groups of bounded
size; each group is packed by best-fit decreasing and its container count is
certified by dual-feasible-function lower bounds.  Groups whose count exceeds
the bound (a gap) give up their containers that aren't full, certified groups
only the ones that are far from full; what is given up is exchanged between the
groups by another hash and packed again, while that saves containers.

An item is split only if it alone exceeds the capacity: into full pieces and a
rest, and each full piece fills one container.  Items of size 0 need no space
and go where they fall.  Null sizes are left out.  Equal sizes and repeated ids
are packed as they come (piece numbers keep pieces of one id apart).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import Stages

#: Pieces a group has about: what one task packs at a time.
GROUP_ITEMS = 40_000
#: A certified group gives up containers filled less than this.
LOW_FILL = 0.98
ROUNDS = 3
_PACKED = "item_id bigint, piece int, size bigint, grp bigint, container bigint, fill bigint, bound bigint, used bigint"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest of the bounds given by three families of dual feasible functions.

    The identity gives the volume bound; the thresholds a (sizes above capacity - a count as whole, those below a as
    nothing) and the rounding functions floor((k + 1) x) / k give the others.  All work on the counts of each size.
    """
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    value = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * value)])
    best = -(-int(total[-1]) // capacity)
    half = capacity // 2
    a = np.arange(0, half + 1)
    whole = n[-1] - n[capacity - a + 1]
    middle = n[capacity - a + 1] - n[half + 1]
    middle_sum = total[capacity - a + 1] - total[half + 1]
    small_sum = total[half + 1] - total[a]
    rest = np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))
    best = max(best, int((whole + middle + rest).max()))
    for k in range(1, 33):
        scaled = (k + 1) * value
        # x is kept where (k + 1) x is whole, else rounded down to a multiple of 1 / k; in units of 1 / (k * capacity)
        f = np.where(scaled % capacity == 0, value * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item.  The open containers of each free space are a stack; a bit set finds the least free space that suffices."""
    out = np.zeros(len(sizes), dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = bits >> s
        if fit:
            room = s + (fit & -fit).bit_length() - 1
            c = free[room].pop()
            if not free[room]:
                bits ^= 1 << room
        else:
            room, c = capacity, used
            used += 1
        out[i] = c
        left = room - s
        if not free[left]:
            bits |= 1 << left
        free[left].append(c)
    return out


def _pack_group(capacity: int, base: int):  # noqa: ANN202
    def pack(t: pa.Table) -> pa.Table:
        sizes, grp = t.column("size").to_numpy(), t.column("grp")[0].as_py()
        bins = best_fit_decreasing(sizes, capacity)
        used = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes, minlength=used).astype(np.int64)
        n = len(sizes)
        return pa.table(
            [t.column("item_id"), t.column("piece"), t.column("size"), t.column("grp"), pa.array(((base + grp) << 32) + bins), pa.array(fill[bins])]
            + [pa.array(np.full(n, v, dtype=np.int64)) for v in (lower_bound(sizes, capacity), used)],
            names=["item_id", "piece", "size", "grp", "container", "fill", "bound", "used"],
        )

    return pack


def pieces_of(items: DataFrame, capacity: int, id_col: str, size_col: str) -> DataFrame:
    """(item_id, piece, size): one row per item, more for an item over the capacity."""
    size = F.col(size_col).cast("bigint")
    return (
        items.select(F.col(id_col).cast("bigint").alias("item_id"), size.alias("whole"))
        .filter("whole IS NOT NULL AND whole >= 0")
        .select("item_id", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / capacity)).cast("int"))).alias("piece"))
        .select("item_id", "piece", F.least(F.lit(capacity).cast("bigint"), F.col("whole") - F.col("piece").cast("bigint") * capacity).alias("size"))
    )


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "tokens", group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: item_id, piece, size, grp, container, fill, bound and used (of the group that packed it).

    Cost: one shuffle of three integers per piece, and per exchange round one of what was given up.  The driver sees counts only.
    """
    stages = Stages(items.sparkSession, "packing")

    def packed(pieces: DataFrame, n: int, salt: int) -> DataFrame:
        groups = max(1, -(-n // group_items))
        keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("item_id", "piece", F.lit(salt)), F.lit(groups)))
        return stages.cut(keyed.groupBy("grp").applyInArrow(_pack_group(capacity, salt << 20), _PACKED))

    pieces = stages.cut(pieces_of(items, capacity, id_col, size_col))
    done = packed(pieces, pieces.count(), 0)
    stages.drop(pieces)
    kept: list[DataFrame] = []
    for salt in range(1, ROUNDS + 1):
        loose = F.when(F.col("used") > F.col("bound"), F.col("fill") < capacity).otherwise(F.col("fill") < LOW_FILL * capacity)
        given = done.filter(loose)
        before = given.agg(F.countDistinct("container").alias("c"), F.count("*").alias("n"), F.sum("size").alias("s")).first()
        if before.c <= max(1, -(-(before.s or 0) // capacity)):
            break
        again = packed(given.select("item_id", "piece", "size"), before.n, salt)
        after = again.agg(F.countDistinct("container").alias("c")).first().c
        if after >= before.c:
            stages.drop(again)
            break
        kept.append(done.filter(~loose))
        done = again
    for part in kept:
        done = done.unionByName(part)
    return done


def certificates(packed: DataFrame) -> DataFrame:
    """Per group that packed anything that stayed: containers kept, the bound and count it had, and whether that count was certified."""
    return packed.groupBy(F.shiftright("container", 32).alias("packing")).agg(
        F.countDistinct("container").alias("containers"), F.count("*").alias("pieces"), F.sum("size").alias("size"), F.max("bound").alias("bound"), F.max("used").alias("packed"), (F.max("used") == F.max("bound")).alias("certified")
    )
