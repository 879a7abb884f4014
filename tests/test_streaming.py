from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import orphans as O
from corpusloom.operators import windows
from corpusloom.streaming import events, ledger

T = datetime(2025, 1, 1)
SCHEMA = "user_id int, ts timestamp, failed boolean"


def feed(spark, path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/b={i}")
    return spark.readStream.schema(SCHEMA + ", b int").option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


ROWS = [(1, T + timedelta(minutes=m), f) for m, f in ((0, True), (5, True), (300, False), (301, True))] + [(2, T, True), (9, T + timedelta(days=3), False)]


def test_strikes_follow_the_batch_form(spark, tmp_path):
    run(events.strikes(feed(spark, str(tmp_path), [ROWS[:3], ROWS[3:]]), "user_id", "ts", "failed"), "update", "strikes")
    last = {r.user_id: r.fails for r in spark.sql("SELECT user_id, max_by(fails, n) AS fails FROM (SELECT *, monotonically_increasing_id() AS n FROM strikes) GROUP BY 1").collect()}
    want = {r.user_id: r.fails for r in windows.strikes(spark.createDataFrame(ROWS, SCHEMA), "user_id", "ts", "failed").collect()}
    assert {k: v for k, v in last.items() if v} == want


def test_bursts_and_seen(spark, tmp_path):
    run(events.bursts(feed(spark, str(tmp_path / "a"), [ROWS]), "user_id", "ts", "1 hour"), "append", "bursts")
    got = {(r.user_id, r.n) for r in spark.table("bursts").collect()}
    assert {(1, 2), (1, 2), (2, 1)} <= got
    run(events.seen_once(feed(spark, str(tmp_path / "b"), [ROWS[:2], ROWS]), "user_id", "ts"), "append", "seen")
    assert spark.table("seen").count() == 3


def test_orphan_sink_versions(spark, tmp_path):
    sink = ledger.orphan_sink(
        spark,
        str(tmp_path / "state"),
        lambda b: O.references(b.filter("kind = 'ref'").select(F.col("id").alias("artifact_id"), F.col("ref").alias("run_id"), F.col("at").alias("ts"), F.col("at").alias("ingested_at")), "artifacts", "artifact_id", {"run_id": "runs"}),
        lambda b: O.parent_times(b.filter("kind = 'run'").select(F.col("id").alias("run_id"), F.col("at").alias("ingested_at")), "runs", "run_id"),
    )
    schema = "kind string, id string, ref string, at timestamp"
    sink(spark.createDataFrame([("ref", "a", "r1", T), ("ref", "b", "r2", T)], schema), 0)
    sink(spark.createDataFrame([("run", "r1", None, T)], schema), 1)
    sink(spark.createDataFrame([("run", "r2", None, T)], schema), 1)  # a batch that was done already
    tables = ledger.VersionedTables(spark, str(tmp_path / "state"))
    assert tables.version() == 1
    assert {(r.record_id, r.reason) for r in tables.read("pending").collect()} == {("b", "missing")}


def test_index_sink(spark, tmp_path):
    sink = ledger.index_sink(spark, str(tmp_path / "i"), "k", "t", "n")
    sink(spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "b", 1)], "k int, t string, n int"), 0)
    sink(spark.createDataFrame([(2, "a", 1), (2, "c", 2), (3, None, 1)], "k int, t string, n int"), 1)
    got = {(r.k, r.t) for r in ledger.VersionedTables(spark, str(tmp_path / "i")).read("index").collect()}
    assert got == {(1, "a"), (2, "c"), (3, None)}
