"""Most similar vectors for every vector (problem 7).

Method: low-dimensional stable projections indexed by kd-trees.  Unit vectors are projected onto M Gaussian directions;
the squared projected distance of two vectors, divided by their squared distance, is chi-square distributed with M
degrees of freedom.  A kd-tree over the projections (medians of a bounded sample; every vector is indexed) cuts them into
blocks, each block is cut into cells by a tree of its own.  A query goes through the cells in the order of its chances
there, and chi-square tests stop it, given the distance of its k-th neighbour so far (or that of the least similarity
asked for):

* a box that lies beyond k of its sides, at squared distance d, holds a neighbour at distance r with a chance of at most
  2^-k P(chi-square with k degrees >= d / r^2); boxes whose chance is under ``chance`` aren't visited.  A cell's chance is
  at most its block's, so the same test prunes blocks before the shuffle and cells after it;
* in a cell only points whose projected distance is within the CONFIDENCE quantile of M degrees are verified exactly.

A pair is found if either vector visits the other's cell.  With ``chance`` 0.05 a query visits at most the cells that
differ in four sides, which is a falling share of them (README has figures).

Equal vectors are one point of the index, known by their least ids, so copies of one vector never make a large cell.
Ties go to the lesser id.  Vectors travel as 16-bit integers, which moves a similarity by about 5e-6.

Defined results: unusable vectors (null, another length than dim, a value null or not finite, all zero) are left out,
repeated rows of an id count once (of different vectors the one with the least key), vectors of different dim never
meet; an empty table gives no pairs.

Costs: one shuffle of the vectors to collapse copies, one of points and visits.  The plan is the same at every size; the
number of blocks follows the rows.  Block trees have at most SAMPLE / 16 leaves; they and counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import Stages

M = 16
CONFIDENCE = 0.999
CHANCE = 0.05
SAMPLE = 65_536
#: Rows of a block, and the least number of blocks.
BLOCK, LEAST_BLOCKS = 16_384, 8
CELL = 256
#: Visitors of a block beyond which they are searched in several tasks.
SLICE = 262_144
_SCALE = 32_000.0


def chi_square_quantile(p: float, m: int) -> float:
    """By Wilson and Hilferty, good to a few per mille for m of 10 and more."""
    z = NormalDist().inv_cdf(p)
    return m * (1 - 2 / (9 * m) + z * (2 / (9 * m)) ** 0.5) ** 3


def chi_square_tail(k: int, x: float) -> float:
    """P(chi-square with k degrees >= x), by the finite series."""
    half = x / 2
    if k % 2:
        total, term, at = math.erfc(math.sqrt(half)), math.sqrt(2 * x / math.pi) * math.exp(-half), 3
    else:
        total, term, at = 0.0, math.exp(-half), 2
    while at <= k:
        total += term
        term *= x / at
        at += 2
    return total


def reach_of_sides(chance: float, most: int = M) -> np.ndarray:
    """For boxes beyond 0..most sides: the greatest d / r^2 at which the chance still is ``chance``; nan where none is."""
    out = [np.inf]
    for k in range(1, most + 1):
        low, high = 0.0, 400.0
        if 0.5**k < chance:
            out.append(np.nan)
            continue
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if 0.5**k * chi_square_tail(k, mid) >= chance else (low, mid)
        out.append(low)
    return np.array(out, dtype=np.float32)


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(7_000_003 + dim).standard_normal((dim, M)).astype(np.float32)


class Tree:
    """A kd-tree over projections: median splits of the coordinate with the greatest variance; its leaves tile the box given."""

    def __init__(self, points: np.ndarray, leaves: int, low: np.ndarray | None = None, high: np.ndarray | None = None):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        width = points.shape[1]
        self.root = self._build(points, leaves, np.full(width, -np.inf, np.float32) if low is None else low, np.full(width, np.inf, np.float32) if high is None else high)
        self.leaves = len(self.boxes)
        self.low, self.high = np.array([b[0] for b in self.boxes]), np.array([b[1] for b in self.boxes])

    def _build(self, points: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray) -> int:
        if leaves > 1 and len(points) > 1:
            axis = int(points.var(0).argmax())
            at = float(np.median(points[:, axis]))
            below = points[:, axis] < at
            if below.any():
                n = len(self.nodes)
                self.nodes.append((axis, at, 0, 0))
                inner, outer = high.copy(), low.copy()
                inner[axis] = outer[axis] = at
                self.nodes[n] = (axis, at, self._build(points[below], leaves // 2, low, inner), self._build(points[~below], leaves - leaves // 2, outer, high))
                return n
        self.boxes.append((low, high))
        return -len(self.boxes)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                axis, at, left, right = self.nodes[node]
                below = points[rows, axis] < at
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def needed(self, points: np.ndarray, sides: np.ndarray) -> np.ndarray:
        """For each point and leaf the least squared distance r^2 of a neighbour from which the leaf is worth a visit; inf: none."""
        gaps, beyond = np.zeros((len(points), self.leaves), np.float32), np.zeros((len(points), self.leaves), np.int8)
        for c in range(points.shape[1]):
            low, high = self.low[:, c], self.high[:, c]
            if np.isinf(low).all() and np.isinf(high).all():
                continue
            x = points[:, c : c + 1]
            gap = np.maximum(np.maximum(low - x, x - high), 0)
            gaps += gap * gap
            beyond += gap > 0
        out = gaps / sides[beyond]
        return np.nan_to_num(out, copy=False, nan=np.inf)


def search(ids: np.ndarray, x: np.ndarray, px: np.ndarray, tree: Tree, qids: np.ndarray, q: np.ndarray, pq: np.ndarray, reach: np.ndarray, k: int, least: float, sides: np.ndarray, verified: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k best (similarity at least ``least``) of the points for each query, as ids (-1: none) and similarities.

    ``reach`` is the squared distance within which a neighbour is of interest at first; ``verified`` collects how many
    points were verified.
    """
    leaf = tree.leaf_of(px)
    order = np.argsort(leaf, kind="stable")
    bounds = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    x, px, ids = x[order], px[order], ids[order]
    square, q_square = (px * px).sum(1), (pq * pq).sum(1)
    keep = chi_square_quantile(CONFIDENCE, M)
    needed = tree.needed(pq, sides)
    turn = np.argsort(needed, axis=1, kind="stable")
    sims, best = np.full((len(q), k), -2.0), np.full((len(q), k), -1, dtype=np.int64)
    reach = reach.astype(np.float64).copy()
    active = np.arange(len(q))
    for r in range(tree.leaves):
        cell = turn[active, r]
        # the stopping test: from here on no cell is worth a visit, given the distance so far
        far = needed[active, cell]
        going = (far <= reach[active]) & np.isfinite(far)
        active, cell = active[going], cell[going]
        if not len(active):
            break
        by = np.argsort(cell, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
            mine, a, b = active[part], bounds[cell[part[0]]], bounds[cell[part[0]] + 1]
            # projected distances first: only what passes the test of M degrees is verified
            near = square[a:b] + q_square[mine][:, None] - 2 * (pq[mine] @ px[a:b].T)
            i, j = np.nonzero(near <= (keep * reach[mine])[:, None])
            i, j = mine[i], j + a
            other = qids[i] != ids[j]
            i, j = i[other], j[other]
            if verified is not None:
                verified.append(len(i))
            if not len(i):
                continue
            exact = np.einsum("ij,ij->i", q[i], x[j]).astype(np.float64)
            good = exact >= np.maximum(least, sims[i, k - 1])
            i, j, exact = i[good], ids[j[good]], exact[good]
            if not len(i):
                continue
            rows, at = np.unique(i, return_inverse=True)
            # the k best of what each had and what it found
            who = np.concatenate([np.repeat(np.arange(len(rows)), k), at])
            sim, point = np.concatenate([sims[rows].ravel(), exact]), np.concatenate([best[rows].ravel(), j])
            o = np.lexsort((point, -sim, who))
            who, sim, point = who[o], sim[o], point[o]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            first = place < k
            sims[rows[who[first]], place[first]], best[rows[who[first]], place[first]] = sim[first], point[first]
            full = rows[sims[rows, k - 1] > -2]
            reach[full] = np.minimum(reach[full], 2 - 2 * sims[full, k - 1])
    return best, sims


def _packed(unit: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.rint(unit * _SCALE).astype("<i2")]


def _unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, dim).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), kind))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, key, vec) of the usable vectors: a key of the unit vector, and its packed form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, dims = batch.column(0), batch.column(1), batch.column(2)
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            wanted = dims.fill_null(0).to_numpy(zero_copy_only=False)
            fine = (sizes == wanted) & (wanted > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
            for d in np.unique(wanted[fine]).tolist():
                rows = pa.array(np.flatnonzero(fine & (wanted == d)))
                v = lists.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                with np.errstate(invalid="ignore"):
                    top = np.abs(v).max(1)
                    good = np.isfinite(v).all(1) & (top > 0)
                v = v[good] / top[good, None]
                if len(v):
                    unit = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
                    keys = [xxhash.xxh3_128_digest(u.tobytes()) for u in unit]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(rows.filter(pa.array(good))), pa.array(np.full(len(v), d, dtype=np.int32)), pa.array(keys, pa.binary()), pa.array(_packed(unit), pa.binary())], names=["vec_id", "dim", "key", "vec"]
                    )

    cols = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<float>"), F.col("dim").cast("int"))
    return cols.mapInArrow(run, "vec_id bigint, dim int, key binary, vec binary")


def _plan(points: DataFrame, sides: np.ndarray, reach: float, block: int) -> dict[int, tuple[Tree, np.ndarray]]:
    """Per dim a tree of blocks over a bounded sample of the projections, and into how many slices each block's visitors are cut."""
    trees = {}
    for r in points.groupBy("dim").count().collect():
        share = min(1.0, SAMPLE / r["count"])
        pick = points.filter((F.col("dim") == r.dim) & (F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(share * 1_000_000))).select("vec")
        # rows leave in the order of their vectors, so that a lost executor leads to the same tree
        vecs = sorted(bytes(x.vec) for x in pick.collect())
        sample = _unpacked(pa.array(vecs, pa.binary()), r.dim) @ directions(r.dim) if vecs else np.zeros((1, M), np.float32)
        leaves = 2 ** math.ceil(math.log2(max(LEAST_BLOCKS, r["count"] / block)))
        tree = Tree(sample, min(leaves, SAMPLE // 16))
        visitors = (tree.needed(sample, sides) <= min(reach, 1.0)).sum(0) * (r["count"] / len(sample))
        trees[r.dim] = tree, np.maximum(1, np.ceil(visitors / SLICE)).astype(np.int64)
    return trees


_ROUTED = "dim int, block int, slice int, role boolean, rep bigint, vec binary, reach double"


def neighbours(vectors: DataFrame, k: int = 5, least: float = 0.86, chance: float = CHANCE, block: int = BLOCK) -> DataFrame:
    """(vec_id, other, similarity): up to k most similar of each vector among those of at least that similarity.

    With a least similarity one round of visits is enough.  Without one a first round in the home block finds how far a
    query has to look.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "neighbours")
    sides = reach_of_sides(chance)
    whole = stages.cut(usable(vectors))
    ids = whole.groupBy("vec_id").agg(F.min(F.struct("dim", "key")).alias("p")).select("vec_id", "p.dim", "p.key")
    # the least ids of each group of copies: a window limit, cut down to k + 1 rows per group before the shuffle
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("dim", "key").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    members = few.groupBy("dim", "key").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    vecs = whole.groupBy("dim", "key").agg(F.first("vec").alias("vec"))
    points = stages.cut(members.join(vecs, ["dim", "key"]).withColumn("rep", F.col("members")[0]))
    start, floor = (2 - 2 * least, least) if least > -1 else (float("inf"), -2.0)
    shared = spark.sparkContext.broadcast(_plan(points, sides, start, block))

    def route(batches: Iterator[pa.RecordBatch], home: bool, away: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                tree, slices = shared.value[d]
                p = _unpacked(part.column(2), d) @ directions(d)
                own, rep, reach = tree.leaf_of(p), part.column(1).to_numpy(), part.column(3).to_numpy()
                rows, blocks, number, role = [], [], [], []
                if home:  # a point lives in every slice of its block
                    n = slices[own]
                    at = np.repeat(np.arange(len(p)), n)
                    rows, blocks, role = [at], [own[at]], [np.ones(len(at), bool)]
                    number = [np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
                if away:
                    near = tree.needed(p, sides)
                    near[np.arange(len(p)), own] = np.inf
                    i, b = np.nonzero((near <= reach[:, None]) & np.isfinite(near))
                    rows, blocks, role, number = [*rows, i], [*blocks, b], [*role, np.zeros(len(i), bool)], [*number, rep[i] % slices[b]]
                at = np.concatenate(rows)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array(np.concatenate(blocks), pa.int32()), pa.array(np.concatenate(number), pa.int32()), pa.array(np.concatenate(role)), part.column(1).take(take), part.column(2).take(take), part.column(3).take(take)],
                    names=["dim", "block", "slice", "role", "rep", "vec", "reach"],
                )

    def searched(within: bool, beyond: bool):  # noqa: ANN202
        def run(t: pa.Table) -> pa.Table:
            d, b = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
            tree = shared.value[d][0]
            role = t.column("role").to_numpy()
            x = _unpacked(t.column("vec"), d)
            px, rep, reach = x @ directions(d), t.column("rep").to_numpy(), t.column("reach").to_numpy()
            here = np.flatnonzero(role)
            # residents search in the slice that is theirs, visitors in the one they were sent to
            own = here if not within else here[rep[here] % shared.value[d][1][b] == t.column("slice")[0].as_py()]
            asks = np.concatenate([own if within else own[:0], np.flatnonzero(~role) if beyond else own[:0]])
            cells = Tree(px[here], max(1, 2 ** math.ceil(math.log2(max(1, len(here) / CELL)))), tree.low[b], tree.high[b]) if len(here) else None
            if cells is None or not len(asks):
                return pa.table({"q": pa.array([], pa.int64()), "others": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float64()))})
            best, sims = search(rep[here], x[here], px[here], cells, rep[asks], x[asks], px[asks], reach[asks], k, floor, sides)
            some = np.flatnonzero(best[:, 0] >= 0)
            return pa.table([pa.array(rep[asks][some]), _lists(best[some], pa.int64()), _lists(sims[some], pa.float64())], names=["q", "others", "sims"])

        return run

    found = "q bigint, others array<bigint>, sims array<double>"
    by = ["dim", "block", "slice"]
    asked = points.select("dim", "rep", "vec", F.lit(start).alias("reach"))
    if least > -1:
        results = asked.mapInArrow(lambda x: route(x, True, True), _ROUTED).groupBy(*by).applyInArrow(searched(True, True), found)
    else:
        homes = stages.cut(asked.mapInArrow(lambda x: route(x, True, False), _ROUTED))
        first = stages.cut(homes.groupBy(*by).applyInArrow(searched(True, False), found))
        kth = first.select(F.col("q").alias("rep"), F.when(F.col("sims")[k - 1] > -2, 2 - 2 * F.col("sims")[k - 1]).otherwise(F.lit(4.0)).alias("reach"))
        going = asked.drop("reach").join(kth, "rep", "left").select("dim", "rep", "vec", F.coalesce("reach", F.lit(4.0)).alias("reach"))
        visits = going.mapInArrow(lambda x: route(x, False, True), _ROUTED)
        results = first.unionByName(visits.unionByName(homes).groupBy(*by).applyInArrow(searched(False, True), found))
    flat = results.select("q", F.explode(F.arrays_zip("others", "sims")).alias("z")).select("q", F.col("z.others").alias("o"), F.col("z.sims").alias("s")).filter("o >= 0")
    # a pair that only one of two found counts for both
    both = flat.select("q", "o", "s").unionByName(flat.select(F.col("o").alias("q"), F.col("q").alias("o"), "s"))
    first_k = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("o"))
    once = both.groupBy("q", "o").agg(F.max("s").alias("s"))
    top = once.withColumn("n", F.row_number().over(first_k)).filter(F.col("n") <= k).select("q", "o", "s")
    return _expand(ids, points, top, k)


def _expand(ids: DataFrame, points: DataFrame, top: DataFrame, k: int) -> DataFrame:
    """From points to vectors: copies come first, then the members of the points nearby, k in all."""
    groups = points.filter(F.size("members") > 1).select("dim", "key", "rep", "members")
    own = (
        ids.join(groups, ["dim", "key"])
        .select("vec_id", F.explode(F.expr(f"slice(filter(members, x -> x != vec_id), 1, {k})")).alias("other"), F.lit(1.0).alias("similarity"))
    )
    known = groups.select(F.col("rep").alias("o"), "members")
    near = top.join(known, "o", "left").select("q", "s", F.explode(F.coalesce("members", F.array("o"))).alias("other"))
    mine = groups.select(F.col("rep").alias("q"), "members")
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("other")))).filter(F.col("n") <= k)
    held = ranked.join(mine, "q", "left").filter(F.col("members").isNull() | (F.size("members") - 1 + F.col("n") <= k))
    beyond = held.select(F.explode(F.coalesce("members", F.array("q"))).alias("vec_id"), "other", F.col("s").alias("similarity"))
    return own.unionByName(beyond)


def similar_pairs(vectors: DataFrame, k: int = 5, least: float = 0.86) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of at least that similarity of which one is among the k most similar of the other."""
    near = neighbours(vectors, k, least)
    return near.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
