"""Incremental jobs as foreachBatch sinks: orphan references, and an index that follows its documents.

State lives in written tables, one version per batch; a version is complete before the pointer file names it, so a batch
that is run again after a failure begins from the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.joins import changed
from corpusloom.operators.orphans import PARENTS, REFERENCES, OrphanState


class VersionedTables:
    """Named tables in a folder, replaced together; the newest complete version is the greatest one with a marker."""

    def __init__(self, spark: SparkSession, root: str, keep: int | None = 2):
        """``keep``: how many versions stay; None for logs, of which every version is a part."""
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: object):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *map(str, parts)]))

    def version(self) -> int:
        fs, at = self._fs(), self._path()
        if not fs.exists(at):
            return -1
        done = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit() and fs.exists(self._path(s.getPath().getName(), "_DONE"))]
        return max(done, default=-1)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version() if version is None else version}/{name}")

    def write(self, version: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{version}/{name}")
        self._fs().create(self._path(version, "_DONE"), True).close()
        # the version before stays for a batch that is run again, older ones go
        for s in self._fs().listStatus(self._path()) if self.keep else []:
            name = s.getPath().getName()
            if name.isdigit() and int(name) <= version - self.keep:
                self._fs().delete(s.getPath(), True)

    def log(self, name: str, versions: range, schema: str) -> DataFrame:
        """What complete versions added to a log."""
        done = [f"{self.root}/{v}/{name}" for v in versions if self._fs().exists(self._path(v, "_DONE"))]
        return self.spark.read.schema(schema).parquet(*done)


def orphan_sink(spark: SparkSession, root: str, references, parents):  # noqa: ANN001, ANN201
    """A foreachBatch function over a stream of rows: ``references(batch)`` and ``parents(batch)`` give what it brings.

    Version n holds what batch n added to the logs and the orphans pending after it; a batch that is already in a version
    is skipped.
    """
    tables = VersionedTables(spark, root, keep=None)

    def apply(batch: DataFrame, epoch: int) -> None:
        at = tables.version()
        if at >= epoch:
            return
        state = OrphanState.empty(spark)
        if at >= 0:
            every = range(at + 1)
            state = OrphanState(tables.log("references", every, REFERENCES), tables.log("parents", every, PARENTS), tables.read("pending", at))
        after = state.apply(references(batch), parents(batch))
        tables.write(epoch, references=after.added, parents=after.changed, pending=after.pending)

    return apply


def index_sink(spark: SparkSession, root: str, key: str, text: str, order: str):  # noqa: ANN201
    """A foreachBatch function that keeps (key, text, digest) of the newest text per key by the column ``order``, on a tie the
    greatest; a batch's texts are newer than those kept."""
    tables = VersionedTables(spark, root)

    def apply(batch: DataFrame, epoch: int) -> None:
        at = tables.version()
        if at >= epoch:
            return
        new = batch.groupBy(key).agg(F.max_by(text, F.struct(order, text)).alias(text)).withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
        if at < 0:
            tables.write(epoch, index=new)
            return
        old = tables.read("index", at)
        fresh = changed(new, old.join(new.select(key), key, "left_semi"), key, "digest").filter("change IN ('new', 'changed')").select(key)
        tables.write(epoch, index=old.join(fresh, key, "left_anti").unionByName(new.join(fresh, key, "left_semi")))

    return apply
