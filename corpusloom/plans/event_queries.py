"""Queries over runs, calls, artifacts, retrieval events and the event stream, with their SQL.

Trailing windows are anchored at the last timestamp of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import decay as D
from corpusloom.functions.ids import clean_id
from corpusloom.operators import windows as W
from corpusloom.sources.tables import table

_BAD = ("revise", "reject")


def _t(name: str):  # noqa: ANN202
    return lambda spark, d: table(spark, d, name)


runs, calls, artifacts, retrievals, events, prunes = map(_t, ("runs", "llm_calls", "artifacts", "retrieval_events", "events", "prune_log"))


def _recent(df: DataFrame, ts: str, days: int) -> DataFrame:
    end = df.agg(F.max(ts).alias("_end"))
    return df.join(F.broadcast(end)).filter(F.col(ts) >= F.col("_end") - F.make_dt_interval(F.lit(days))).drop("_end")


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("finish", F.get_json_object("metadata_json", "$.finish_reason"))


def _when(c) -> F.Column:  # noqa: ANN001
    return F.sum(F.when(c, 1).otherwise(0))


def q_call_health(spark: SparkSession, d: str) -> DataFrame:
    c = _finish(_recent(calls(spark, d), "ts", 30))
    return c.groupBy(F.coalesce(F.when(F.col("stage") != "", F.col("stage")), F.lit("unknown")).alias("stage")).agg(
        F.count("*").alias("total"), _when(F.col("status") == "failed").alias("failed"), _when(F.col("finish") == "length").alias("truncated"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens")
    )


def q_call_health_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).withColumn("stage", F.coalesce("stage", F.lit("unknown")))
    return c.rollup("stage").agg(F.count("*").alias("total"), _when(F.col("status") == "failed").alias("failed"), F.round(_when(F.col("status") == "failed") / F.count("*"), 6).alias("error_rate"))


def q_json_predicate(spark: SparkSession, d: str) -> DataFrame:
    return _finish(calls(spark, d)).filter("finish = 'length'").groupBy("stage", "model").agg(F.count("*").alias("truncated"))


def q_truncation_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per stage of at least 5 calls."""
    c = _finish(calls(spark, d)).groupBy("stage").agg(F.count("*").alias("n"), _when(F.col("finish") == "length").alias("cut"))
    return c.filter("n >= 5").select("stage", "n", F.round(F.col("cut") / F.col("n"), 6).alias("rate"))


def q_verdict_axis(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).filter("quality_verdict IS NOT NULL AND quality_verdict != ''")
    v = F.col("quality_verdict")
    g = a.groupBy(F.coalesce("artifact_type", F.lit("?")).alias("artifact_type")).agg(
        F.count("*").alias("total"), _when(v.isin(*_BAD)).alias("content_bad"), _when(v == "unparseable").alias("unparseable"), _when(v == "error").alias("gate_error")
    )
    rate = (F.col("content_bad") + F.col("unparseable") + F.col("gate_error")) / F.col("total")
    return g.withColumn("rate", F.round(rate, 6)).withColumn("lamp", F.when(rate >= 0.5, "red").when(rate >= 0.25, "yellow").otherwise("green"))


def q_worst_type(spark: SparkSession, d: str) -> DataFrame:
    v = q_verdict_axis(spark, d).filter("content_bad > 0")
    return v.agg(F.max_by("artifact_type", F.struct(F.round(F.col("content_bad") / F.col("total"), 9), "artifact_type")).alias("worst"))


def q_routing(spark: SparkSession, d: str) -> DataFrame:
    """Calls per provider and model, and each model's share of its provider."""
    c = calls(spark, d).groupBy("provider", "model").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("provider"))
    return c.select("provider", "model", "n", F.round(share, 6).alias("share"))


def q_status_matrix(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    return r.groupBy("status").agg(F.count("*").alias("total"), _when(F.col("ended_at").isNull()).alias("open"), _when(F.col("parent_run_id").isNull()).alias("roots"), F.countDistinct("intent").alias("intents"))


def q_canary(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality of artifacts with a trace against those without; alarm if the latter are better by 0.1, with 5 of each."""
    a = artifacts(spark, d).filter("quality_score IS NOT NULL")
    has = F.col("trace_id").isNotNull() & (F.trim("trace_id") != "")
    g = a.agg(_when(has).alias("grounded_n"), _when(~has | has.isNull()).alias("cold_n"), F.round(F.avg(F.when(has, F.col("quality_score"))), 6).alias("grounded"), F.round(F.avg(F.when(~has | has.isNull(), F.col("quality_score"))), 6).alias("cold"))
    state = F.when((F.col("grounded_n") < 5) | (F.col("cold_n") < 5), "insufficient").when(F.col("cold") - F.col("grounded") >= 0.1, "alarm").otherwise("ok")
    return g.withColumn("status", state)


def q_validation(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d)
    return a.groupBy("artifact_type").agg(
        F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.round(_when(F.col("quality_score") < 8) / F.count("quality_score"), 6).alias("broken_rate"), F.round(F.count("quality_score") / F.count("*"), 6).alias("coverage")
    )


def q_dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return artifacts(spark, d).groupBy("artifact_id").agg(F.count("*").alias("n")).filter("n > 1")


def q_distinct_queries(spark: SparkSession, d: str) -> DataFrame:
    q = F.trim("query_text")
    return retrievals(spark, d).filter(q != "").groupBy(q.alias("query")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"), F.count("*").alias("n"))


_RESULTS = "array<struct<id:string,title:string,source:string>>"


def q_json_explode(spark: SparkSession, d: str) -> DataFrame:
    """Distinct titles of the results, with how often each was retrieved; broken JSON gives none."""
    r = retrievals(spark, d).filter("status = 'succeeded'").select(F.explode(F.from_json("results_json", _RESULTS)).alias("r"))
    return r.filter("r.title IS NOT NULL").groupBy("r.title").agg(F.count("*").alias("n"), F.countDistinct("r.id").alias("ids"))


def q_explain(spark: SparkSession, d: str) -> DataFrame:
    """Results of each retrieval event by place."""
    r = retrievals(spark, d).dropDuplicates(["retrieval_id"]).select("retrieval_id", F.posexplode(F.from_json("results_json", _RESULTS)).alias("place", "r"))
    return r.filter("r.id IS NOT NULL").select("retrieval_id", (F.col("place") + 1).alias("place"), F.col("r.id").alias("id"), F.col("r.source").alias("source"))


def q_tag_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Result titles that at least two sources share."""
    r = retrievals(spark, d).select(F.explode(F.from_json("results_json", _RESULTS)).alias("r"))
    return r.groupBy("r.title").agg(F.countDistinct("r.source").alias("sources")).filter("sources >= 2 AND title IS NOT NULL")


def q_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Per retrieval source, how many other sources share a title with it (by the titles' sets of sources)."""
    r = retrievals(spark, d).select(F.explode(F.from_json("results_json", _RESULTS)).alias("r")).filter("r.title IS NOT NULL AND r.source IS NOT NULL")
    sets = r.groupBy("r.title").agg(F.collect_set("r.source").alias("s"))
    pairs = sets.select(F.explode("s").alias("source"), "s").select("source", F.explode("s").alias("other")).filter("source != other").distinct()
    return pairs.groupBy("source").agg(F.count("*").alias("degree"))


def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Recorded status of a call against what its error says; missing and contradicting ones stay in the denominator."""
    c = calls(spark, d).select(F.coalesce("status", F.lit("missing")).alias("recorded"), F.when(F.col("error").isNull(), "clean").otherwise("error").alias("observed"))
    return c.groupBy("recorded").pivot("observed", ["clean", "error"]).count().na.fill(0)


def q_revival(spark: SparkSession, d: str) -> DataFrame:
    """Of the pruned records of each table, how many were recorded again later."""
    p = prunes(spark, d).groupBy(F.lower(F.trim("table_name")).alias("table_name"), F.lower(F.trim("record_id")).alias("id")).agg(F.max("pruned_at").alias("pruned_at"))
    seen = runs(spark, d).select(F.lit("runs").alias("table_name"), F.lower(F.trim("run_id")).alias("id"), "ingested_at").unionByName(calls(spark, d).select(F.lit("llm_calls").alias("table_name"), F.lower(F.trim("trace_id")).alias("id"), "ingested_at"))
    again = seen.groupBy("table_name", "id").agg(F.max("ingested_at").alias("last_at"))
    j = p.join(again, ["table_name", "id"], "left")
    return j.groupBy("table_name").agg(F.count("*").alias("pruned"), _when(F.col("last_at") > F.col("pruned_at")).alias("revived"), F.round(_when(F.col("last_at") > F.col("pruned_at")) / F.count("*"), 6).alias("rate"))


def q_topn_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).distinct().filter(F.col("intent").like("maintenance.%") | (F.col("trigger_type") == "maintenance_scheduler")).dropDuplicates(["run_id"])
    top = W.first_per_group(r, ["intent"], [F.col("started_at").desc_nulls_last(), F.col("run_id")], 3)
    return top.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(60).select("run_id", "intent", "rank")


def q_topn_artifacts(spark: SparkSession, d: str) -> DataFrame:
    a = artifacts(spark, d).filter("quality_verdict IS NOT NULL").select("artifact_id", "artifact_type", "ts", "quality_verdict").distinct()
    top = W.first_per_group(a, ["artifact_type"], [F.col("ts").desc_nulls_last(), F.col("artifact_id")], 3)
    return top.orderBy(F.col("ts").desc_nulls_last(), "artifact_id").limit(30).select("artifact_id", "artifact_type", "quality_verdict", "rank")


def q_topn_failures(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).filter("status = 'failed'").select("trace_id", "stage", "ts", F.substring("error", 1, 300).alias("error")).distinct()
    top = W.first_per_group(c, ["stage"], [F.col("ts").desc_nulls_last(), F.col("trace_id")], 2)
    return top.orderBy(F.col("ts").desc_nulls_last(), "trace_id").limit(20).select("trace_id", "stage", "error", "rank")


def q_first_result(spark: SparkSession, d: str) -> DataFrame:
    """Each run's newest maintenance result."""
    a = artifacts(spark, d).filter("artifact_type = 'maintenance_result' AND trim(run_id) != ''").select(F.lower(F.trim("run_id")).alias("run_id"), "artifact_id", "ts").distinct()
    first = W.first_per_group(a, ["run_id"], [F.col("ts").desc_nulls_last(), F.col("artifact_id")], 1)
    ids = runs(spark, d).select(F.lower(F.trim("run_id")).alias("run_id")).distinct()
    return ids.join(first, "run_id").select("run_id", "artifact_id")


def q_recent_runs(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d).select("run_id", "started_at").distinct()
    return r.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(20).select("run_id")


def q_latest_n(spark: SparkSession, d: str) -> DataFrame:
    """The 365 latest events of each user."""
    e = W.first_per_group(events(spark, d).select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 365)
    return e.groupBy("user_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("least_id"), F.max("event_id").alias("greatest_id"))


def _lamps(spark: SparkSession, d: str) -> DataFrame:
    """A lamp per stage and day, by the day's failure rate."""
    c = calls(spark, d).filter("ts IS NOT NULL").groupBy(F.coalesce("stage", F.lit("unknown")).alias("axis"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), _when(F.col("status") == "failed").alias("bad"))
    rate = F.col("bad") / F.col("n")
    return c.select("axis", "day", F.round(rate, 9).alias("rate"), F.when(rate >= 0.05, "red").when(rate > 0, "yellow").otherwise("green").alias("lamp"))


_RANKS = {"green": 0, "yellow": 1, "red": 2}


def q_trend(spark: SparkSession, d: str) -> DataFrame:
    return W.trend(_lamps(spark, d), "axis", "day", "lamp", _RANKS).select("axis", "day", "lamp", "arrow")


def q_streak(spark: SparkSession, d: str) -> DataFrame:
    return W.streaks(_lamps(spark, d), "axis", "day", "lamp").select("axis", "day", "lamp", "streak")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").cast("double").alias("n"))


def q_tail_drops(spark: SparkSession, d: str) -> DataFrame:
    return W.tail_drops(_daily(spark, d), "event_type", "day", "n")


def q_regression(spark: SparkSession, d: str) -> DataFrame:
    """A day's rate against the one before, as a regression flag."""
    prev = F.lag("rate").over(Window.partitionBy("axis").orderBy("day"))
    return _lamps(spark, d).withColumn("prev", prev).select("axis", "day", F.coalesce(F.col("rate") > F.col("prev"), F.lit(False)).alias("regressed"))


def q_day_streak(spark: SparkSession, d: str) -> DataFrame:
    return W.day_streaks(events(spark, d), "user_id", "ts").groupBy("user_id").agg(F.max("streak").alias("longest"), F.count("*").alias("days"))


def q_strikes(spark: SparkSession, d: str) -> DataFrame:
    return W.strikes(events(spark, d).withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed").select("user_id", "fails", "blocked")


def q_seen_window(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "crawled_items").filter("dedupe_key IS NOT NULL AND fetched_at IS NOT NULL")
    return W.seen_window(keys, "dedupe_key", "fetched_at").select("dedupe_key", "active")


def q_session_debounce(spark: SparkSession, d: str) -> DataFrame:
    return W.debounce(events(spark, d), "user_id", "ts", "2 hours").groupBy("user_id").agg(F.count("*").alias("bursts"), F.max("n").alias("longest"))


def q_trailing_window(spark: SparkSession, d: str) -> DataFrame:
    return _recent(events(spark, d), "ts", 7).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def q_hour_window(spark: SparkSession, d: str) -> DataFrame:
    """Events between 22 and 4 o'clock."""
    return events(spark, d).filter((F.hour("ts") >= 22) | (F.hour("ts") < 4)).groupBy("event_type").agg(F.count("*").alias("n"))


def q_prune(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of 180 days would remove of each table; tables go by their own times, without cascade."""
    out = None
    for name, ts in (("runs", "started_at"), ("llm_calls", "ts"), ("artifacts", "ts"), ("retrieval_events", "ts")):
        t = table(spark, d, name).select(F.lit(name).alias("table_name"), F.col(ts).alias("ts"))
        end = t.agg(F.max("ts").alias("e"))
        part = t.join(F.broadcast(end)).groupBy("table_name").agg(_when(F.col("ts") < F.col("e") - F.make_dt_interval(F.lit(180))).alias("removed"), F.count("*").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


def q_reap(spark: SparkSession, d: str) -> DataFrame:
    """Running runs older than a day become interrupted."""
    r = runs(spark, d)
    end = r.agg(F.max("started_at").alias("e"))
    stale = (F.col("status") == "running") & (F.col("started_at") < F.col("e") - F.make_dt_interval(F.lit(1)))
    return r.join(F.broadcast(end)).groupBy(F.when(stale, "interrupted").otherwise(F.col("status")).alias("status")).agg(F.count("*").alias("n"))


def q_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic tenth of the runs by a hash of the id."""
    bucket = F.pmod(F.conv(F.substring(F.sha2("run_id", 256), -15, 15), 16, 10).cast("bigint"), F.lit(100))
    return runs(spark, d).select("run_id").distinct().filter(bucket < 10)


def q_due_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Intents whose last run is at least 6 days before the end of the data."""
    r = runs(spark, d).filter("intent IS NOT NULL").groupBy("intent").agg(F.max("started_at").alias("last"))
    end = r.agg(F.max("last").alias("e"))
    return r.join(F.broadcast(end)).select("intent", (F.datediff("e", "last") >= 6).alias("due"))


def q_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait after each user's failures: doubling from 60, at most 3,600."""
    s = W.strikes(events(spark, d).withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed")
    return s.select("user_id", F.least(F.lit(3600.0), 60.0 * F.pow(F.lit(2.0), F.col("fails") - 1)).cast("bigint").alias("wait_s"))


def q_stale(spark: SparkSession, d: str) -> DataFrame:
    """Open runs at least 30 whole days old."""
    r = runs(spark, d).filter("ended_at IS NULL AND started_at IS NOT NULL").groupBy("run_id").agg(F.min("started_at").alias("started_at"))
    end = runs(spark, d).agg(F.max("started_at").alias("e"))
    age = F.floor((F.unix_micros("e") - F.unix_micros("started_at")) / 86_400_000_000)
    return r.join(F.broadcast(end)).select("run_id", age.alias("days")).filter("days >= 30")


def q_version_drift(spark: SparkSession, d: str) -> DataFrame:
    """Calls by a model that isn't the stage's most used one."""
    c = calls(spark, d).filter("stage IS NOT NULL AND model IS NOT NULL").groupBy("stage", "model").agg(F.count("*").alias("n"))
    top = c.groupBy("stage").agg(F.max_by("model", F.struct("n", "model")).alias("usual"))
    return c.join(top, "stage").filter("model != usual").select("stage", "model", "usual", "n")


def q_unused(spark: SparkSession, d: str) -> DataFrame:
    """Runs that no artifact and no retrieval names: known ids less used ones."""
    ids = lambda t: t.select(clean_id("run_id").alias("run_id")).filter("run_id IS NOT NULL").distinct()
    return ids(runs(spark, d)).join(ids(artifacts(spark, d)).union(ids(retrievals(spark, d))), "run_id", "left_anti")


def q_scorecard(spark: SparkSession, d: str) -> DataFrame:
    """Axes of several tables and the worst lamp of all."""
    c = calls(spark, d).agg(F.avg(F.when(F.col("status") == "failed", 1.0).otherwise(0.0)).alias("v")).select(F.lit("calls").alias("axis"), "v")
    a = artifacts(spark, d).filter("quality_verdict IS NOT NULL").agg(F.avg(F.when(F.col("quality_verdict") != "keep", 1.0).otherwise(0.0)).alias("v")).select(F.lit("verdicts").alias("axis"), "v")
    r = retrievals(spark, d).agg(F.avg(F.when(F.from_json("results_json", _RESULTS).isNull(), 1.0).otherwise(0.0)).alias("v")).select(F.lit("retrieval").alias("axis"), "v")
    every = c.unionByName(a).unionByName(r).select("axis", F.round("v", 6).alias("value"), F.when(F.col("v") >= 0.5, 2).when(F.col("v") >= 0.25, 1).otherwise(0).alias("lamp"))
    return every.unionByName(every.agg(F.lit("overall").alias("axis"), F.lit(None).cast("double").alias("value"), F.max("lamp").alias("lamp")))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts as claims: strength by score, reinforced at ts."""
    a = artifacts(spark, d)
    end = a.agg(F.max("ts").alias("now"))
    g = a.groupBy("artifact_id").agg(F.max("ts").alias("ts"), F.max("quality_score").alias("quality_score"), F.max("quality_verdict").alias("verdict"))
    return g.join(F.broadcast(end)).withColumn("s", F.coalesce("quality_score", F.lit(0.0)) / 4).withColumn("r", D.retrievability(F.col("s"), F.col("ts"), F.col("now")))


def _status(c: DataFrame) -> DataFrame:
    was = F.when(F.col("verdict") == "reject", "falsified").when(F.col("verdict") == "revise", "fading").when(F.col("verdict").isNull(), "dormant").otherwise("active")
    return c.withColumn("status", was)


def q_decay(spark: SparkSession, d: str) -> DataFrame:
    return _claims(spark, d).select("artifact_id", F.round(D.half_life(F.col("s")), 6).alias("half_life"), F.round("r", 6).alias("r"))


def q_status(spark: SparkSession, d: str) -> DataFrame:
    c = _status(_claims(spark, d).withColumn("r", F.round("r", 9)))
    return c.withColumn("next", D.next_status(F.col("status"), F.col("r"))).groupBy("status", "next").agg(F.count("*").alias("n"))


def q_due_claims(spark: SparkSession, d: str) -> DataFrame:
    """The 20 claims nearest to being forgotten among those below 0.6."""
    c = _claims(spark, d).withColumn("r", F.round("r", 9)).filter("r < 0.6")
    return c.orderBy("r", "artifact_id").limit(20).select("artifact_id")


def q_confidence(spark: SparkSession, d: str) -> DataFrame:
    """First confidence 0.3 + 0.4 score (0.5 without one), less 0.2 per contradiction, 0.1 at least."""
    c = _claims(spark, d)
    against = F.when(F.col("verdict") == "reject", 1).otherwise(0)
    base = F.when(F.col("quality_score").isNull(), 0.5).otherwise(0.3 + 0.4 * F.col("quality_score") / 10)
    return c.select("artifact_id", F.round(F.greatest(F.lit(0.1), base - 0.2 * against), 6).alias("confidence"))


def q_seed_targets(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of 50 by least recent use, the rest by most interest."""
    e = events(spark, d).groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("interest"))
    old = e.orderBy("last", "user_id").limit(10).select("user_id", F.lit("explore").alias("why"))
    rest = e.join(old.select("user_id"), "user_id", "left_anti").orderBy(F.desc("interest"), "user_id").limit(40).select("user_id", F.lit("exploit").alias("why"))
    return old.unionByName(rest)


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_FIN = "CASE WHEN json_valid(metadata_json) THEN json_extract_string(metadata_json, '$.finish_reason') END"
_LAMPS = """lamps AS (SELECT axis, day, round(bad / n, 9) AS rate, CASE WHEN bad / n >= 0.05 THEN 'red' WHEN bad > 0 THEN 'yellow' ELSE 'green' END AS lamp FROM (
  SELECT coalesce(stage, 'unknown') AS axis, strftime(ts AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS bad FROM llm_calls WHERE ts IS NOT NULL GROUP BY 1, 2))"""
_RES = "CASE WHEN json_valid(results_json) THEN from_json(results_json, '[{\"id\":\"VARCHAR\",\"title\":\"VARCHAR\",\"source\":\"VARCHAR\"}]') END"
_CLAIMS = "claims AS (SELECT *, exp(-greatest(0.0::DOUBLE, date_diff('microsecond', ts, (SELECT max(ts) FROM artifacts)) / 86400000000.0::DOUBLE) * ln(2.0::DOUBLE) / (21.0::DOUBLE * pow(1.8::DOUBLE, s))) AS r0 FROM (SELECT artifact_id, max(ts) AS ts, max(quality_score) AS quality_score, max(quality_verdict) AS verdict, coalesce(max(quality_score), 0) / 4 AS s FROM artifacts GROUP BY 1))"
_R = "coalesce(r0, 1.0::DOUBLE)"
_STRIKES = "strikes AS (SELECT user_id, count(*) AS fails, max(ts) AS last_fail FROM events e LEFT JOIN (SELECT user_id, max(ts) AS ok FROM events WHERE event_type <> 'error' GROUP BY 1) o USING (user_id) WHERE event_type = 'error' AND (ok IS NULL OR ts > ok) GROUP BY 1)"
SQL = {
    "q_call_health": f"SELECT coalesce(nullif(stage, ''), 'unknown') AS stage, count(*) AS total, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN {_FIN} = 'length' THEN 1 ELSE 0 END)::BIGINT AS truncated, coalesce(sum(total_tokens), 0)::BIGINT AS tokens FROM llm_calls WHERE ts >= (SELECT max(ts) FROM llm_calls) - INTERVAL 30 DAY GROUP BY 1",
    "q_call_health_rollup": "SELECT stage, count(*) AS total, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed, round(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) / count(*), 6) AS error_rate FROM (SELECT coalesce(stage, 'unknown') AS stage, status FROM llm_calls) GROUP BY ROLLUP (stage)",
    "q_json_predicate": f"SELECT stage, model, count(*) AS truncated FROM llm_calls WHERE {_FIN} = 'length' GROUP BY 1, 2",
    "q_truncation_rate": f"SELECT stage, count(*) AS n, round(sum(CASE WHEN {_FIN} = 'length' THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM llm_calls GROUP BY 1 HAVING count(*) >= 5",
    "q_verdict_axis": "SELECT *, round((content_bad + unparseable + gate_error) / total, 6) AS rate, CASE WHEN (content_bad + unparseable + gate_error) / total >= 0.5 THEN 'red' WHEN (content_bad + unparseable + gate_error) / total >= 0.25 THEN 'yellow' ELSE 'green' END AS lamp FROM (SELECT coalesce(artifact_type, '?') AS artifact_type, count(*) AS total, sum((quality_verdict IN ('revise', 'reject'))::INT)::BIGINT AS content_bad, sum((quality_verdict = 'unparseable')::INT)::BIGINT AS unparseable, sum((quality_verdict = 'error')::INT)::BIGINT AS gate_error FROM artifacts WHERE quality_verdict <> '' GROUP BY 1)",
    "q_worst_type": "SELECT arg_max(artifact_type, (round(bad / total, 9), artifact_type)) AS worst FROM (SELECT coalesce(artifact_type, '?') AS artifact_type, count(*) AS total, sum((quality_verdict IN ('revise', 'reject'))::INT) AS bad FROM artifacts WHERE quality_verdict <> '' GROUP BY 1) WHERE bad > 0",
    "q_routing": "SELECT provider, model, n, round(n / sum(n) OVER (PARTITION BY provider), 6) AS share FROM (SELECT provider, model, count(*) AS n FROM llm_calls GROUP BY 1, 2)",
    "q_status_matrix": "SELECT status, count(*) AS total, sum((ended_at IS NULL)::INT)::BIGINT AS open, sum((parent_run_id IS NULL)::INT)::BIGINT AS roots, count(DISTINCT intent) AS intents FROM runs GROUP BY 1",
    "q_canary": "SELECT *, CASE WHEN grounded_n < 5 OR cold_n < 5 THEN 'insufficient' WHEN cold - grounded >= 0.1 THEN 'alarm' ELSE 'ok' END AS status FROM (SELECT sum(h)::BIGINT AS grounded_n, sum(1 - h)::BIGINT AS cold_n, round(avg(CASE WHEN h = 1 THEN quality_score END), 6) AS grounded, round(avg(CASE WHEN h = 0 THEN quality_score END), 6) AS cold FROM (SELECT quality_score, coalesce(trim(trace_id) <> '', false)::INT AS h FROM artifacts WHERE quality_score IS NOT NULL))",
    "q_validation": "SELECT artifact_type, count(*) AS n, round(avg(quality_score), 6) AS mean_score, round(sum(CASE WHEN quality_score < 8 THEN 1 ELSE 0 END) / count(quality_score), 6) AS broken_rate, round(count(quality_score) / count(*), 6) AS coverage FROM artifacts GROUP BY 1",
    "q_dup_keys": "SELECT artifact_id, count(*) AS n FROM artifacts GROUP BY 1 HAVING count(*) > 1",
    "q_distinct_queries": "SELECT trim(query_text) AS query, strftime(max(ts) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n FROM retrieval_events WHERE trim(query_text) <> '' GROUP BY 1",
    "q_json_explode": f"SELECT r.title AS title, count(*) AS n, count(DISTINCT r.id) AS ids FROM (SELECT unnest({_RES}) AS r FROM retrieval_events WHERE status = 'succeeded') WHERE r.title IS NOT NULL GROUP BY 1",
    "q_explain": f"SELECT retrieval_id, place::INTEGER AS place, r.id AS id, r.source AS source FROM (SELECT retrieval_id, unnest(j) AS r, generate_subscripts(j, 1) AS place FROM (SELECT DISTINCT retrieval_id, {_RES} AS j FROM retrieval_events)) WHERE r.id IS NOT NULL",
    "q_tag_clusters": f"SELECT r.title AS title, count(DISTINCT r.source) AS sources FROM (SELECT unnest({_RES}) AS r FROM retrieval_events) WHERE r.title IS NOT NULL GROUP BY 1 HAVING count(DISTINCT r.source) >= 2",
    "q_connectivity": f"WITH r AS (SELECT DISTINCT r.title AS title, r.source AS source FROM (SELECT unnest({_RES}) AS r FROM retrieval_events) WHERE r.title IS NOT NULL AND r.source IS NOT NULL) SELECT a.source, count(DISTINCT b.source) AS degree FROM r a JOIN r b USING (title) WHERE a.source <> b.source GROUP BY 1",
    "q_confusion": "SELECT coalesce(status, 'missing') AS recorded, sum((error IS NULL)::INT)::BIGINT AS clean, sum((error IS NOT NULL)::INT)::BIGINT AS error FROM llm_calls GROUP BY 1",
    "q_revival": "WITH p AS (SELECT lower(trim(table_name)) AS table_name, lower(trim(record_id)) AS id, max(pruned_at) AS pruned_at FROM prune_log GROUP BY 1, 2), s AS (SELECT table_name, id, max(ingested_at) AS last_at FROM (SELECT 'runs' AS table_name, lower(trim(run_id)) AS id, ingested_at FROM runs UNION ALL SELECT 'llm_calls', lower(trim(trace_id)), ingested_at FROM llm_calls) GROUP BY 1, 2) SELECT table_name, count(*) AS pruned, sum(coalesce(last_at > pruned_at, false)::INT)::BIGINT AS revived, round(sum(coalesce(last_at > pruned_at, false)::INT) / count(*), 6) AS rate FROM p LEFT JOIN s USING (table_name, id) GROUP BY 1",
    "q_topn_runs": "SELECT run_id, intent, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY started_at DESC NULLS LAST, run_id) AS rank FROM (SELECT run_id, any_value(intent) AS intent, any_value(started_at) AS started_at FROM runs WHERE intent LIKE 'maintenance.%' OR trigger_type = 'maintenance_scheduler' GROUP BY 1)) WHERE rank <= 3 ORDER BY started_at DESC NULLS LAST, run_id LIMIT 60",
    "q_topn_artifacts": "SELECT artifact_id, artifact_type, quality_verdict, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY artifact_type ORDER BY ts DESC NULLS LAST, artifact_id) AS rank FROM (SELECT DISTINCT artifact_id, artifact_type, ts, quality_verdict FROM artifacts WHERE quality_verdict IS NOT NULL)) WHERE rank <= 3 ORDER BY ts DESC NULLS LAST, artifact_id LIMIT 30",
    "q_topn_failures": "SELECT trace_id, stage, error, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ts DESC NULLS LAST, trace_id) AS rank FROM (SELECT DISTINCT trace_id, stage, ts, substr(error, 1, 300) AS error FROM llm_calls WHERE status = 'failed')) WHERE rank <= 2 ORDER BY ts DESC NULLS LAST, trace_id LIMIT 20",
    "q_first_result": "SELECT run_id, artifact_id FROM (SELECT run_id, artifact_id, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC NULLS LAST, artifact_id) AS n FROM (SELECT DISTINCT lower(trim(run_id)) AS run_id, artifact_id, ts FROM artifacts WHERE artifact_type = 'maintenance_result' AND trim(run_id) <> '')) WHERE n = 1 AND run_id IN (SELECT lower(trim(run_id)) FROM runs)",
    "q_recent_runs": "SELECT run_id FROM (SELECT DISTINCT run_id, started_at FROM runs) ORDER BY started_at DESC NULLS LAST, run_id LIMIT 20",
    "q_latest_n": "SELECT user_id, count(*) AS kept, min(event_id) AS least_id, max(event_id) AS greatest_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 365 GROUP BY 1",
    "q_trend": f"WITH {_LAMPS}, p AS (SELECT *, lag(lamp) OVER (PARTITION BY axis ORDER BY day) AS prev FROM lamps), k AS (SELECT *, array_position(['green', 'yellow', 'red'], lamp) AS a, array_position(['green', 'yellow', 'red'], prev) AS b FROM p) SELECT axis, day, lamp, CASE WHEN prev IS NULL THEN 'none' WHEN a > b THEN 'up' WHEN a < b THEN 'down' ELSE 'same' END AS arrow FROM k",
    "q_streak": f"WITH {_LAMPS}, c AS (SELECT *, CASE WHEN lamp IS NOT DISTINCT FROM lag(lamp) OVER (PARTITION BY axis ORDER BY day) THEN 0 ELSE 1 END AS c FROM lamps), g AS (SELECT *, sum(c) OVER (PARTITION BY axis ORDER BY day) AS g FROM c) SELECT axis, day, lamp, row_number() OVER (PARTITION BY axis, g ORDER BY day)::INTEGER AS streak FROM g",
    "q_tail_drops": "WITH n AS (SELECT event_type, ts::DATE AS day, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, row_number() OVER w AS i, coalesce(n < lag(n) OVER w - 1e-9, false) AS drop FROM n WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, (max(i) - max(CASE WHEN NOT drop THEN i END))::INTEGER AS drops FROM s GROUP BY 1",
    "q_regression": f"WITH {_LAMPS} SELECT axis, day, coalesce(rate > lag(rate) OVER (PARTITION BY axis ORDER BY day), false) AS regressed FROM lamps",
    "q_day_streak": "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS g FROM d), s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, g ORDER BY day) AS streak FROM i) SELECT user_id, max(streak)::INTEGER AS longest, count(*) AS days FROM s GROUP BY 1",
    "q_strikes": f"WITH {_STRIKES} SELECT user_id, fails, fails >= 3 AND (SELECT max(ts) FROM events) - last_fail < INTERVAL 7 DAY AS blocked FROM strikes",
    "q_seen_window": "SELECT dedupe_key, max(fetched_at) >= (SELECT max(fetched_at) FROM crawled_items WHERE dedupe_key IS NOT NULL) - INTERVAL 30 DAY AS active FROM crawled_items WHERE dedupe_key IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1",
    "q_session_debounce": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS bursts, max(n) AS longest FROM n GROUP BY 1",
    "q_trailing_window": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "q_hour_window": "SELECT event_type, count(*) AS n FROM events WHERE hour(ts) >= 22 OR hour(ts) < 4 GROUP BY 1",
    "q_prune": " UNION ALL ".join(f"SELECT '{n}' AS table_name, sum(coalesce({t} < (SELECT max({t}) FROM {n}) - INTERVAL 180 DAY, false)::INT)::BIGINT AS removed, count(*) AS total FROM {n}" for n, t in (("runs", "started_at"), ("llm_calls", "ts"), ("artifacts", "ts"), ("retrieval_events", "ts"))),
    "q_reap": "SELECT CASE WHEN status = 'running' AND started_at < (SELECT max(started_at) FROM runs) - INTERVAL 1 DAY THEN 'interrupted' ELSE status END AS status, count(*) AS n FROM runs GROUP BY 1",
    "q_hash_sample": "SELECT run_id FROM (SELECT DISTINCT run_id FROM runs) WHERE ('0x' || right(sha256(run_id), 15))::BIGINT % 100 < 10",
    "q_due_tasks": "SELECT intent, date_diff('day', (max(started_at) AT TIME ZONE 'UTC')::DATE, ((SELECT max(started_at) FROM runs WHERE intent IS NOT NULL) AT TIME ZONE 'UTC')::DATE) >= 6 AS due FROM runs WHERE intent IS NOT NULL GROUP BY 1",
    "q_backoff": f"WITH {_STRIKES} SELECT user_id, least(3600.0, 60.0 * pow(2.0, fails - 1))::BIGINT AS wait_s FROM strikes",
    "q_stale": "SELECT run_id, (date_diff('microsecond', min(started_at), (SELECT max(started_at) FROM runs)) // 86400000000)::BIGINT AS days FROM runs WHERE ended_at IS NULL AND started_at IS NOT NULL GROUP BY 1 HAVING date_diff('microsecond', min(started_at), (SELECT max(started_at) FROM runs)) // 86400000000 >= 30",
    "q_version_drift": "WITH c AS (SELECT stage, model, count(*) AS n FROM llm_calls WHERE stage IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2), t AS (SELECT stage, arg_max(model, (n, model)) AS usual FROM c GROUP BY 1) SELECT stage, model, usual, n FROM c JOIN t USING (stage) WHERE model <> usual",
    "q_unused": "SELECT lower(trim(run_id)) AS run_id FROM runs WHERE trim(run_id) <> '' EXCEPT (SELECT lower(trim(run_id)) FROM artifacts UNION ALL SELECT lower(trim(run_id)) FROM retrieval_events)",
    "q_scorecard": f"WITH v AS (SELECT 'calls' AS axis, avg((coalesce(status = 'failed', false))::INT) AS v FROM llm_calls UNION ALL SELECT 'verdicts', avg((quality_verdict <> 'keep')::INT) FROM artifacts WHERE quality_verdict IS NOT NULL UNION ALL SELECT 'retrieval', avg(({_RES} IS NULL)::INT) FROM retrieval_events), e AS (SELECT axis, round(v, 6) AS value, (CASE WHEN v >= 0.5 THEN 2 WHEN v >= 0.25 THEN 1 ELSE 0 END)::INTEGER AS lamp FROM v) SELECT * FROM e UNION ALL SELECT 'overall', NULL, max(lamp) FROM e",
    "q_decay": f"WITH {_CLAIMS} SELECT artifact_id, round(21.0::DOUBLE * pow(1.8::DOUBLE, s), 6) AS half_life, round({_R}, 6) AS r FROM claims",
    "q_status": f"WITH {_CLAIMS}, c AS (SELECT round({_R}, 9) AS r, CASE WHEN verdict = 'reject' THEN 'falsified' WHEN verdict = 'revise' THEN 'fading' WHEN verdict IS NULL THEN 'dormant' ELSE 'active' END AS status FROM claims) SELECT status, CASE WHEN status = 'falsified' THEN 'falsified' WHEN status = 'dormant' THEN CASE WHEN r > 0.6 THEN 'active' WHEN r > 0.3 THEN 'fading' ELSE 'dormant' END WHEN status = 'fading' THEN CASE WHEN r > 0.6 THEN 'active' WHEN r < 0.2 THEN 'dormant' ELSE 'fading' END WHEN r < 0.2 THEN 'dormant' WHEN r < 0.5 THEN 'fading' ELSE 'active' END AS next, count(*) AS n FROM c GROUP BY 1, 2",
    "q_due_claims": f"WITH {_CLAIMS} SELECT artifact_id FROM claims WHERE round({_R}, 9) < 0.6 ORDER BY round({_R}, 9), artifact_id LIMIT 20",
    "q_confidence": "SELECT artifact_id, round(greatest(0.1::DOUBLE, CASE WHEN max(quality_score) IS NULL THEN 0.5::DOUBLE ELSE 0.3::DOUBLE + 0.4::DOUBLE * max(quality_score) / 10 END - 0.2::DOUBLE * CASE WHEN max(quality_verdict) = 'reject' THEN 1 ELSE 0 END), 6) AS confidence FROM artifacts GROUP BY 1",
    "q_seed_targets": "WITH e AS (SELECT user_id, max(ts) AS last, count(*) AS interest FROM events GROUP BY 1), o AS (SELECT user_id FROM e ORDER BY last, user_id LIMIT 10), r AS (SELECT user_id FROM e WHERE user_id NOT IN (SELECT user_id FROM o) ORDER BY interest DESC, user_id LIMIT 40) SELECT user_id, 'explore' AS why FROM o UNION ALL SELECT user_id, 'exploit' FROM r",
}
