"""Registered queries of the core: name -> (spark, directory) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import hierarchy, orphans
from corpusloom.plans import corpus_queries, event_queries, index_queries, kernel_queries, retrieval_queries, text_queries
from corpusloom.plans.retrieval_queries import flagship  # noqa: F401
from corpusloom.sources.tables import table


def _hierarchy(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.Hierarchy(hierarchy.both_kinds(table(spark, d, "runs"), table(spark, d, "llm_calls")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every node whose parent field isn't blank."""
    h = _hierarchy(spark, d)
    child = h.links.filter("parent IS NOT NULL").select("node")
    return hierarchy.kind_and_id(h.roots().join(child, "node")).select("node_kind", "node_id", F.expr("substring(root, 3)").alias("root_id"), "depth")


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and the number of descendants of every node under a root."""
    h = hierarchy.kind_and_id(_hierarchy(spark, d).labelled())
    return h.select(
        "node_kind", "node_id", F.expr("substring(root, 3)").alias("root_id"), "depth", F.array_join(F.transform("path", lambda x: F.substring(x, 3, 1 << 30)), "/").alias("path"), (F.col("size") - 1).alias("descendants")
    )


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The preorder interval of every node under a root: its descendants are the nodes of its root numbered in (first, last]."""
    h = hierarchy.kind_and_id(_hierarchy(spark, d).labelled())
    return h.select("node_kind", "node_id", F.expr("substring(root, 3)").alias("root_id"), "first", "last")


def p3_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The nodes on cycles."""
    return hierarchy.kind_and_id(_hierarchy(spark, d).cycles()).select("node_kind", "node_id", F.expr("substring(cycle_id, 3)").alias("cycle_id"), "length")


#: Batches by time in which the tables are applied to the pending-orphan state.
ORPHAN_BATCHES = 3


def _orphan_state(spark: SparkSession, d: str) -> orphans.OrphanState:
    """The state after the tables have come in batches by ingestion time, deletions by the time of pruning."""
    to = {"run_id": "runs", "trace_id": "llm_calls"}
    t = {n: table(spark, d, n) for n in ("artifacts", "retrieval_events", "runs", "llm_calls", "prune_log")}

    def refs(when: Column) -> DataFrame:
        part = lambda n: t[n].withColumn("at", F.col("ingested_at")).filter(when)
        return orphans.references(part("artifacts"), "artifacts", "artifact_id", to).unionByName(orphans.references(part("retrieval_events"), "retrieval_events", "retrieval_id", to))

    def changes(when: Column) -> DataFrame:
        part = lambda n, at: t[n].withColumn("at", F.col(at)).filter(when)
        rows = orphans.parent_times(part("runs", "ingested_at"), "runs", "run_id").unionByName(orphans.parent_times(part("llm_calls", "ingested_at"), "llm_calls", "trace_id"))
        return rows.unionByName(orphans.deletions(part("prune_log", "pruned_at")))

    ends = t["llm_calls"].agg(F.min("ingested_at").alias("a"), F.max("ingested_at").alias("b")).first()
    bounds = [ends.a + (ends.b - ends.a) * k / ORPHAN_BATCHES for k in range(1, ORPHAN_BATCHES)] if ends.a and ends.b and ends.a < ends.b else []
    return orphans.in_batches(spark, refs, changes, bounds)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference that is pending after the last batch."""
    return _orphan_state(spark, d).orphans().select("table_name", "record_id", "field", "reason", "period")


def p4_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, reason and month."""
    return _orphan_state(spark, d).snapshot()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_hierarchy": p3_hierarchy,
    "p3_intervals": p3_intervals,
    "p3_cycles": p3_cycles,
    "p4_found": p4_found,
    "p4_snapshot": p4_snapshot,
} | retrieval_queries.QUERIES | event_queries.QUERIES | text_queries.QUERIES | kernel_queries.QUERIES | corpus_queries.QUERIES | index_queries.QUERIES
