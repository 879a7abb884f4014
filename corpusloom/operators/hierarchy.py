"""Parent-child links to full hierarchies (problem 3).

Method: heavy-path decomposition.

1. ``subtree sizes`` by pointer doubling: in round k every node still active knows its 2^k-th ancestor and adds the
   descendants it has gathered to it.  Nodes whose chain of parents ends drop out after log2(depth) rounds, so the
   active set shrinks quickly; what stays active when a round drops nobody is on a cycle or leads into one: the cycle
   separation.
2. Each node's child with the largest subtree continues its chain (a tie goes to the greater id); every other child
   begins a chain.  Doubling along the heavy edges gives each node its chain's head and its position in the chain.
3. Chains form a tree of at most log2(n) levels.  Doubling over it sums positions to depths and to preorder numbers:
   a chain is an interval, a subtree is the interval [first, first + size).

Nothing is gathered per tree or per parent: every step is an equi-join or an aggregation with partial sums, and sibling
offsets below a parent with many children are prefix sums over buckets of children.  Rounds are written to the shared
folder, so lineage stays short.

Defined results: a node whose parent field is blank or whose parent isn't in the table is a root of depth 0.  Nodes on
a cycle (a node that is its own parent included) or leading into one have no root.  Repeated rows stand for one node;
if they disagree the parent ingested last holds.  Null and blank ids are no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import clean_id
from corpusloom.session import Stages

#: Children of one parent that share a bucket of the sibling prefix sums.
SIBLINGS = 20_000


def parent_links(rows: DataFrame, id_col: str, parent_col: str, order_col: str | None = None) -> DataFrame:
    """(node, parent): one row per id, parent null if blank."""
    order = F.col(order_col) if order_col else F.lit(0)
    return (
        rows.select(clean_id(id_col).alias("node"), F.struct(order.alias("at"), clean_id(parent_col).alias("parent")).alias("last"))
        .filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.max("last").alias("last"))
        .select("node", "last.parent")
    )


class Hierarchy:
    """The decomposition of one table (node, parent); its results are DataFrames."""

    def __init__(self, links: DataFrame):
        self.stages = Stages(links.sparkSession, "hierarchy")
        cut = self.stages.cut
        links = cut(links.select("node", "parent"))
        self.links = links
        parents = links.select("node").alias("p")
        # a parent that isn't a node is none
        self.known = cut(links.alias("c").filter("parent IS NOT NULL").join(parents, F.col("c.parent") == F.col("p.node")).select("c.node", "c.parent"))
        self._sizes()
        self._chains()

    def _sizes(self) -> None:
        cut, drop = self.stages.cut, self.stages.drop
        active, gathered = cut(self.known.select("node", F.col("parent").alias("anc"), F.lit(1).cast("bigint").alias("size"))), []
        n = active.count()
        while n:
            add = cut(active.groupBy(F.col("anc").alias("node")).agg(F.sum("size").alias("add")))
            gathered.append(add)
            a, b = active.alias("a"), active.select(F.col("node").alias("at"), F.col("anc").alias("next")).alias("b")
            further = cut(
                a.join(b, F.col("a.anc") == F.col("b.at"))
                .select("a.node", F.col("b.next").alias("anc"), "a.size")
                .join(add, "node", "left")
                .select("node", "anc", (F.col("size") + F.coalesce("add", F.lit(0))).alias("size"))
            )
            left = further.count()
            drop(active)
            active = further
            if left == n:
                break
            n = left
        #: Nodes on a cycle or leading into one, with an ancestor on the cycle.
        self.cyclic = active.select("node", "anc")
        base = self.links.select("node", F.lit(1).cast("bigint").alias("add"))
        sizes = reduce(DataFrame.unionByName, gathered, base).groupBy("node").agg(F.sum("add").alias("size"))
        self.nodes = cut(
            self.links.select("node").join(self.cyclic.select("node"), "node", "left_anti").join(sizes, "node").join(self.known, "node", "left").select("node", "parent", "size")
        )
        for add in gathered:
            drop(add)

    def _resolve(self, links: DataFrame, weights: list[str]) -> DataFrame:
        """(node, top, weights): acyclic links (node, up, weights) followed to their end, the weights summed on the way."""
        active, done = self.stages.cut(links), []
        while True:
            open_ = active.withColumn("open", F.lit(True))
            state = reduce(DataFrame.unionByName, [x.withColumn("open", F.lit(False)) for x in done], open_)
            state = state.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("open").alias("open_next"), *[F.col(w).alias(f"{w}_next") for w in weights])
            both = self.stages.cut(
                active.join(state, F.col("up") == F.col("at"), "left").select(
                    "node", F.coalesce("next", "up").alias("up"), F.coalesce("open_next", F.lit(False)).alias("open"), *[(F.col(w) + F.coalesce(f"{w}_next", F.lit(0))).alias(w) for w in weights]
                )
            )
            done.append(both.filter("NOT open").drop("open"))
            active = both.filter("open").drop("open")
            if active.isEmpty():
                return reduce(DataFrame.unionByName, done).withColumnRenamed("up", "top")

    def _chains(self) -> None:
        cut = self.stages.cut
        children = self.nodes.filter("parent IS NOT NULL")
        heavy = children.groupBy("parent").agg(F.max(F.struct("size", "node")).alias("h"), F.count("*").alias("children")).select("parent", F.col("h.node").alias("heavy"), F.col("h.size").alias("heavy_size"), "children")
        edges = cut(children.join(heavy, "parent").withColumn("continues", F.col("node") == F.col("heavy")).drop("heavy"))
        runs = self._resolve(edges.filter("continues").select("node", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("pos")), ["pos"])
        #: node -> head of its chain and position in it
        self.place = cut(
            self.nodes.select("node", "size").join(runs, "node", "left").select("node", "size", F.coalesce("top", "node").alias("head"), F.coalesce("pos", F.lit(0)).cast("bigint").alias("pos"))
        )
        begun = edges.filter("NOT continues").select(F.col("node").alias("head"), "parent", F.col("size").alias("head_size"), "heavy_size", "children")
        at = self.place.select(F.col("node").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("parent_pos"))
        #: head -> the chain it hangs on and where
        self.hang = cut(begun.join(at, "parent"))

    def roots(self) -> DataFrame:
        """(node, root, depth) of every node; root '' and depth -1 on or before a cycle."""
        links = self.hang.select(F.col("head").alias("node"), "up", (F.col("parent_pos") + 1).alias("depth"))
        tops = self._resolve(links, ["depth"]).select(F.col("node").alias("head"), "top", "depth")
        good = self.place.join(tops, "head", "left").select("node", F.coalesce("top", "head").alias("root"), (F.coalesce("depth", F.lit(0)) + F.col("pos")).cast("int").alias("depth"))
        return good.unionByName(self.cyclic.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth")))

    def labelled(self) -> DataFrame:
        """(node, root, depth, size, first, last, path) of the nodes under a root.

        ``first`` is the node's preorder number within its root's tree, its descendants are the nodes of the same root
        with numbers in (first, last]; ``path`` lists the ids from the root to the node.
        """
        cut = self.stages.cut
        # offsets among the siblings that begin chains: sums over buckets of bounded size, then within the bucket
        buckets = F.pmod(F.xxhash64("head"), F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("children") / SIBLINGS)))
        light = cut(self.hang.withColumn("bucket", buckets))
        before = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = light.groupBy("parent", "bucket").agg(F.sum("head_size").alias("s")).select("parent", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("earlier"))
        within = Window.partitionBy("parent", "bucket").orderBy(F.col("head_size").desc(), F.col("head").desc()).rowsBetween(Window.unboundedPreceding, -1)
        spot = light.join(sums, ["parent", "bucket"]).select(
            "head", "up", "parent_pos", (F.col("parent_pos") + 1 + F.col("heavy_size") + F.col("earlier") + F.coalesce(F.sum("head_size").over(within), F.lit(0))).alias("first")
        )
        links = spot.select(F.col("head").alias("node"), "up", (F.col("parent_pos") + 1).alias("depth"), "first", F.lit(1).cast("bigint").alias("level"))
        tops = self._resolve(links, ["depth", "first", "level"]).withColumnRenamed("node", "head")
        # paths: chain segments are joined level by level, at most log2(n) levels
        segments = cut(self.place.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("s")).select("head", F.transform("s", lambda x: x.node).alias("segment")))
        chains = cut(segments.join(tops, "head", "left").join(self.hang.select("head", "up", "parent_pos"), "head", "left").withColumn("level", F.coalesce("level", F.lit(0))))
        levels = chains.agg(F.max("level").alias("m")).first().m or 0
        # before: ids above the chain's head
        done = [cut(chains.filter("level = 0").select("head", "segment", F.array().cast("array<string>").alias("above")))]
        for k in range(1, levels + 1):
            up = done[-1].select(F.col("head").alias("up"), F.col("segment").alias("up_segment"), F.col("above").alias("up_above"))
            # a chain of level k hangs on one of level k - 1
            done.append(cut(chains.filter(F.col("level") == k).join(up, "up").select("head", "segment", F.concat("up_above", F.slice("up_segment", F.lit(1), (F.col("parent_pos") + 1).cast("int"))).alias("above"))))
        above = reduce(DataFrame.unionByName, done).join(tops.select("head", "top", "depth", "first"), "head", "left")
        return (
            above.select("head", "above", F.coalesce("top", "head").alias("root"), F.coalesce("depth", F.lit(0)).alias("d"), F.coalesce("first", F.lit(0)).alias("f"), F.posexplode("segment").alias("pos", "node"), "segment")
            .join(self.nodes.select("node", "size"), "node")
            .select(
                "node", "root", (F.col("d") + F.col("pos")).cast("int").alias("depth"), "size", (F.col("f") + F.col("pos")).alias("first"), (F.col("f") + F.col("pos") + F.col("size") - 1).alias("last"),
                F.concat("above", F.slice("segment", F.lit(1), F.col("pos") + 1)).alias("path"),
            )
        )

    def cycles(self) -> DataFrame:
        """(node, cycle_id, length): the nodes on cycles; a cycle is named by its least node.

        Doubling over the cyclic nodes only.  The image of the 2^k-th ancestors shrinks to the cycles' nodes; over these
        the least node within 2^k steps is the cycle's once no round changes it.
        """
        cut = self.stages.cut
        links = self.links.join(self.cyclic.select("node"), "node", "left_semi").select("node", F.col("parent").alias("anc"))
        state, n = cut(links), -1
        while True:
            image = state.select("anc").distinct().count()
            if image == n:
                break
            n = image
            state = cut(state.alias("a").join(state.select(F.col("node").alias("at"), F.col("anc").alias("next")), F.col("a.anc") == F.col("at")).select("node", F.col("next").alias("anc")))
        on = cut(state.select(F.col("anc").alias("node")).distinct())
        state = cut(links.join(on, "node", "left_semi").withColumn("least", F.col("node")))
        while True:
            other = state.select(F.col("node").alias("at"), F.col("anc").alias("next"), F.col("least").alias("least_next"))
            further = cut(state.join(other, F.col("anc") == F.col("at")).select("node", F.col("next").alias("anc"), F.least("least", "least_next").alias("least"), (F.col("least_next") < F.col("least")).alias("moved")))
            state = further.drop("moved")
            if further.filter("moved").isEmpty():
                break
        lengths = state.groupBy("least").agg(F.count("*").alias("length"))
        return state.select("node", "least").join(lengths, "least").select("node", F.col("least").alias("cycle_id"), "length")


def both_kinds(runs: DataFrame, calls: DataFrame) -> DataFrame:
    """Runs and calls as one table of links, told apart by a prefix, so that they share every round."""

    def kind(df: DataFrame, mark: str) -> DataFrame:
        return df.select(F.concat(F.lit(mark), "node").alias("node"), F.concat(F.lit(mark), "parent").alias("parent"))

    return kind(parent_links(runs, "run_id", "parent_run_id", "ingested_at"), "r:").unionByName(kind(parent_links(calls, "trace_id", "parent_trace_id", "ingested_at"), "c:"))


def kind_and_id(df: DataFrame) -> DataFrame:
    """node back to node_kind and node_id."""
    return df.withColumn("node_kind", F.when(F.col("node").startswith("r:"), "run").otherwise("call")).withColumn("node_id", F.expr("substring(node, 3)"))
