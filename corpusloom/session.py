"""Sessions and the places where long lineages are cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session is given."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the session in spark.checkpoint.dir.

    Without that setting a folder of this machine serves sessions whose executors all are this process; others fail.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-shared")
    return named.rstrip("/")


class Stages:
    """Written tables that cut the lineage of iterative operators.

    Each ``cut`` writes a table into the shared folder and reads it back: a lost executor costs
    the step in work only.  ``drop`` removes tables that later steps don't read any more, the end of the JVM all.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        if self.n == 1:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._corpusloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_corpusloom_path", None)
        if path:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
