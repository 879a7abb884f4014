"""References to records that do not exist (problem 4).

Method: keyed pending-orphan state, maintained incrementally.  The state is

* ``parents``, a log of changes per target table and id: the first and last time a row of it was ingested, the last time it
  was pruned;
* ``references``, a log of who refers to what, and when the record was first ingested;
* ``pending``, the references that are orphans now, with the reason.

A batch brings new references, new parents and deletions.  New references probe the parent index; parents and deletions
only touch the references of their keys (arriving parents resolve them or make them late, deletions reopen them).
Everything else keeps its state.  Counts per table, field, reason and period can be snapshot at any time.

The probe first meets distinct keys only (references are aggregated per key before the shuffle), so a key that a third
of all rows refer to is one row in the join; only keys with orphans meet the references again.

Defined results: null and blank references are none.  Repeated rows of a record stand for it once: first ingestion is
their earliest, the period that of their earliest ``ts`` (null for null).  Null record ids give nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import clean_id
from corpusloom.session import Stages

#: reason of a reference to a key with these times, by a record first ingested at ``seen``
_REASON = """
CASE WHEN pruned_at IS NOT NULL AND (last_at IS NULL OR last_at <= pruned_at) THEN 'deleted'
     WHEN first_at IS NULL THEN 'missing'
     WHEN first_at > seen THEN 'late' END
"""


def references(rows: DataFrame, table_name: str, id_col: str, fields: dict[str, str]) -> DataFrame:
    """(table_name, record_id, field, target, ref, seen, period) of the references; ``fields``: field -> target table.

    ``seen`` is the first ingestion of the record over all its rows, not only those that hold the reference.
    """
    record = rows.select(clean_id(id_col).alias("record_id"), F.col("ingested_at"), F.col("ts"), *[clean_id(f).alias(f) for f in fields]).filter("record_id IS NOT NULL")
    once = record.groupBy("record_id").agg(F.min("ingested_at").alias("seen"), F.min("ts").alias("ts"), *[F.collect_set(f).alias(f) for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("target"), F.col(f).alias("refs")) for f, t in fields.items()])
    return (
        once.select("record_id", "seen", F.date_format("ts", "yyyy-MM").alias("period"), F.explode(each).alias("e"))
        .select(F.lit(table_name).alias("table_name"), "record_id", "e.field", "e.target", F.explode("e.refs").alias("ref"), "seen", "period")
    )


def parent_times(rows: DataFrame, target: str, id_col: str) -> DataFrame:
    """(target, ref, first_at, last_at, pruned_at) of the rows of one target table."""
    return _parents(rows.select(F.lit(target).alias("target"), clean_id(id_col).alias("ref"), F.col("ingested_at").alias("first_at"), F.col("ingested_at").alias("last_at"), F.lit(None).cast("timestamp").alias("pruned_at")))


def deletions(log: DataFrame) -> DataFrame:
    """The same of a log of removed records (table_name, record_id, pruned_at)."""
    none = F.lit(None).cast("timestamp")
    return _parents(log.select(F.lower(F.trim("table_name")).alias("target"), clean_id("record_id").alias("ref"), none.alias("first_at"), none.alias("last_at"), "pruned_at"))


def _parents(df: DataFrame) -> DataFrame:
    return df.filter("ref IS NOT NULL").groupBy("target", "ref").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("pruned_at").alias("pruned_at"))


def probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The orphans among the references, with their reason."""
    keys = refs.groupBy("target", "ref").agg(F.min("seen").alias("seen"))
    # a key is of interest if the record that saw it first is an orphan: 'late' holds for no other if not for that one
    open_keys = keys.join(parents, ["target", "ref"], "left").filter(F.expr(_REASON).isNotNull()).drop("seen")
    return refs.join(open_keys, ["target", "ref"]).withColumn("reason", F.expr(_REASON)).filter("reason IS NOT NULL").drop("first_at", "last_at", "pruned_at")


_RECORD = ["table_name", "record_id"]
_KEY = ["target", "ref"]
_REFERENCE = [*_RECORD, "field", *_KEY]
REFERENCES = "table_name string, record_id string, field string, target string, ref string, seen timestamp, period string"
PARENTS = "target string, ref string, first_at timestamp, last_at timestamp, pruned_at timestamp"


@dataclass
class OrphanState:
    """The state after some batches; ``apply`` gives the next one and leaves this as it is.

    ``references`` and ``parents`` are logs that batches only add to (``added`` and ``changed`` are what the last one added);
    ``pending`` holds the orphans, keyed, with their reason.  A batch evaluates the references of its own records and those
    that wait on, or were resolved by, keys it changes; write what it added and ``pending`` to cut lineage.
    """

    references: DataFrame
    parents: DataFrame
    pending: DataFrame
    added: DataFrame | None = None
    changed: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        # an empty range, which the optimiser knows to be empty, so that the first batch joins nothing
        none = lambda schema: spark.range(0).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in schema.split(", ")])
        return cls(none(REFERENCES), none(PARENTS), none(REFERENCES + ", reason string"))

    def apply(self, new_refs: DataFrame, changes: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> OrphanState:
        """``changes``: parent_times and deletions of the batch.  ``keep`` writes a table and gives it back."""
        changes = keep(_parents(changes))
        # a record that comes again was first seen in the earlier batch: its references, old and new, get the earliest times
        own = Window.partitionBy(*_RECORD)
        again = self.references.join(new_refs.select(*_RECORD).distinct(), _RECORD, "left_semi")
        both = new_refs.unionByName(again).withColumn("seen", F.min("seen").over(own)).withColumn("period", F.min("period").over(own))
        added = keep(_once(both))
        touched = _once(self.references.join(changes.select(*_KEY), _KEY, "left_semi").unionByName(added))
        near = self.parents.unionByName(changes).join(touched.select(*_KEY).distinct(), _KEY, "left_semi")
        found = probe(touched, _parents(near))
        pending = keep(self.pending.join(touched.select(*_REFERENCE), _REFERENCE, "left_anti").unionByName(found))
        return OrphanState(self.references.unionByName(added), self.parents.unionByName(changes), pending, added, changes)

    def orphans(self) -> DataFrame:
        return self.pending

    def snapshot(self) -> DataFrame:
        """Counts per table, field, reason and period."""
        return self.orphans().groupBy("table_name", "field", "reason", "period").agg(F.count("*").alias("orphans"))


def _once(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*_REFERENCE).agg(F.min("seen").alias("seen"), F.min("period").alias("period"))


def in_batches(spark: SparkSession, refs: Callable[[Column], DataFrame], changes: Callable[[Column], DataFrame], bounds: list) -> OrphanState:
    """The state after batches by time, each written before the next: ``refs(when)`` and ``changes(when)`` give what came in
    while ``when``, a condition on a column ``at``, holds; ``bounds`` are the times between batches.  Null times come first."""
    stages, state = Stages(spark, "orphans"), OrphanState.empty(spark)
    at = F.col("at")
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        when = (at >= F.lit(low) if low is not None else F.lit(True)) & (at < F.lit(high) if high is not None else F.lit(True))
        state = state.apply(refs(when if low is not None else when | at.isNull()), changes(when if low is not None else when | at.isNull()), stages.cut)
    return state


def reason_of(first_at: Column, last_at: Column, pruned_at: Column, seen: Column) -> Column:
    """The reason as a column expression, for streams that hold the times themselves."""
    return F.when(pruned_at.isNotNull() & (last_at.isNull() | (last_at <= pruned_at)), "deleted").when(first_at.isNull(), "missing").when(first_at > seen, "late")
