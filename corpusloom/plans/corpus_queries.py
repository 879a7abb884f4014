"""Queries over claims, queues, samples and identities, with their SQL.

Artifacts play the claims: a run's artifacts are its evidence, verdicts of reject its contradictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ids import clean_id
from corpusloom.operators import windows as W
from corpusloom.operators.claims import consolidate
from corpusloom.sources.tables import table


def _a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "artifacts").select("artifact_id", clean_id("run_id").alias("run_id"), clean_id("trace_id").alias("trace_id"), "ts", "path", "artifact_type", "quality_verdict", "quality_score").distinct()


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def q_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Claims worth consolidating: judged, not rejected, score at least 5 or unmeasured."""
    return _a(spark, d).filter("quality_verdict IS NOT NULL AND quality_verdict != 'reject' AND coalesce(quality_score, 5) >= 5").select("artifact_id")


def q_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Why a document is no source of its own."""
    p = F.coalesce("path", F.lit(""))
    why = F.when(p == "", "untitled").when(F.lower(p).contains("report"), "own_report").when(F.col("text").isNull() | (F.trim("text") == ""), "empty")
    return _docs(spark, d).select("doc_id", why.alias("reason")).filter("reason IS NOT NULL")


def q_distance_gate(spark: SparkSession, d: str) -> DataFrame:
    """Near, far and unknown kept apart."""
    r = table(spark, d, "retrieval_events")
    return r.groupBy(F.when(F.col("top_k").isNull(), "unknown").when(F.col("top_k") <= 5, "near").otherwise("far").alias("gate")).agg(F.count("*").alias("n"))


def q_active_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A run's evidence as an array, filtered inside it."""
    e = _a(spark, d).filter("run_id IS NOT NULL").groupBy("run_id").agg(F.collect_list(F.struct("artifact_id", "quality_verdict")).alias("e"))
    live = F.filter("e", lambda x: F.coalesce(x.quality_verdict, F.lit("")) != "reject")
    return e.select("run_id", F.size("e").alias("evidence"), F.size(live).alias("active"))


def q_tensions(spark: SparkSession, d: str) -> DataFrame:
    """Runs by tension: contradicted, thin, dogmatic (sure without anything against it), each counted."""
    g = _a(spark, d).filter("run_id IS NOT NULL").groupBy("run_id").agg(
        F.sum(F.when(F.col("quality_verdict") == "reject", 1).otherwise(0)).alias("against"), F.count("*").alias("n"), F.round(F.avg("quality_score"), 9).alias("score")
    )
    kind = F.when(F.col("against") > 0, "contradicted").when(F.col("n") <= 1, "thin").when(F.col("score") >= 8, "dogmatic").otherwise("calm")
    return g.groupBy(kind.alias("tension")).agg(F.count("*").alias("runs"), F.sum("n").alias("evidence"))


def q_falsification(spark: SparkSession, d: str) -> DataFrame:
    """Runs with two rejections of two kinds, the last at least 14 days before the end of the data."""
    a = _a(spark, d)
    end = a.agg(F.max("ts").alias("e"))
    g = a.filter("quality_verdict = 'reject' AND run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n"), F.countDistinct("artifact_type").alias("kinds"), F.max("ts").alias("last"))
    return g.filter("n >= 2 AND kinds >= 2").join(F.broadcast(end)).filter(F.col("last") <= F.col("e") - F.make_dt_interval(F.lit(14))).select("run_id", "n")


def q_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Users with three errors since their last purchase, and whether the last error still blocks them (seven days)."""
    e = table(spark, d, "events").filter("event_type IN ('error', 'purchase') AND user_id IS NOT NULL")
    return W.strikes(e.withColumn("failed", F.col("event_type") == "error"), "user_id", "ts", "failed").filter("fails >= 3").select("user_id", "fails", "blocked")


def q_thin_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The 25 thin runs (one piece of evidence) checked longest ago."""
    g = _a(spark, d).filter("run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).filter("n = 1")
    return g.orderBy("last", "run_id").limit(25).select("run_id")


def q_readiness(spark: SparkSession, d: str) -> DataFrame:
    """100 less penalties per run: 25 for an error, 10 per failed call, 15 per unparseable verdict, 0 at least."""
    r = table(spark, d, "runs").select(clean_id("run_id").alias("run_id"), F.when(F.col("error").isNotNull(), 25).otherwise(0).alias("p"))
    c = table(spark, d, "llm_calls").filter("status = 'failed'").select(clean_id("run_id").alias("run_id"), F.lit(10).alias("p"))
    a = _a(spark, d).filter("quality_verdict = 'unparseable'").select("run_id", F.lit(15).alias("p"))
    runs = r.groupBy("run_id").agg(F.max("p").alias("p"))
    rest = c.unionByName(a).groupBy("run_id").agg(F.sum("p").alias("more"))
    score = F.greatest(F.lit(0).cast("bigint"), 100 - F.col("p") - F.coalesce("more", F.lit(0)))
    return runs.join(rest, "run_id", "left").select("run_id", score.alias("score"), F.when(score >= 80, "ready").when(score >= 50, "caution").otherwise("blocked").alias("verdict"))


def q_median_scores(spark: SparkSession, d: str) -> DataFrame:
    """Median score per type; an unscored artifact counts as 0."""
    return _a(spark, d).groupBy("artifact_type").agg(F.round(F.median(F.coalesce("quality_score", F.lit(0.0))), 6).alias("median"), F.count("*").alias("n"))


def q_findings(spark: SparkSession, d: str) -> DataFrame:
    """Errors as findings: one per key, the most frequent first, twelve at most."""
    c = table(spark, d, "llm_calls").filter("error IS NOT NULL").groupBy(F.lower(F.trim(F.regexp_replace("error", "\\s+", " "))).alias("finding")).agg(F.count("*").alias("n"), F.countDistinct("stage").alias("stages"))
    return c.orderBy(F.desc("n"), "finding").limit(12)


def q_round_scores(spark: SparkSession, d: str) -> DataFrame:
    """Per intent: runs, agents and the longest run."""
    r = table(spark, d, "runs").filter("intent IS NOT NULL").groupBy("run_id", "intent").agg(F.max("agent").alias("agent"), F.max(F.unix_micros("ended_at") - F.unix_micros("started_at")).alias("us"))
    return r.groupBy("intent").agg(F.count("*").alias("runs"), F.countDistinct("agent").alias("agents"), F.max_by("run_id", F.struct("us", "run_id")).alias("longest"))


def q_thesis(spark: SparkSession, d: str) -> DataFrame:
    """A document's first heading."""
    c = table(spark, d, "chunk_snapshots").filter("size(section_path) > 0")
    return c.groupBy("doc_id").agg(F.min_by(F.get("section_path", F.lit(0)), F.struct("char_start", F.get("section_path", F.lit(0)))).alias("thesis"))


def q_natural_key(spark: SparkSession, d: str) -> DataFrame:
    """Paths with the first number padded, so that 2 comes before 10."""
    n = F.regexp_extract("path", "(\\d+)", 1)
    key = F.when(n == "", F.lower("path")).otherwise(F.lower(F.concat(F.regexp_extract("path", "^(\\D*)", 1), F.lpad(n, 12, "0"), F.regexp_extract("path", "^\\D*\\d+(.*)$", 1))))
    return _docs(spark, d).filter("path IS NOT NULL").select("doc_id", key.alias("key"))


def q_representative(spark: SparkSession, d: str) -> DataFrame:
    """One document per folder: the first by natural order, with the folder's newest update."""
    keyed = q_natural_key(spark, d).join(_docs(spark, d).select("doc_id", "path", "updated"), "doc_id")
    return keyed.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.min_by("doc_id", F.struct("key", "doc_id")).alias("doc_id"), F.date_format(F.max("updated"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


def q_backfill_queue(spark: SparkSession, d: str) -> DataFrame:
    """What to index next: over the limit without pieces, then other texts without, the newest first; one hundred at a time."""
    limits = table(spark, d, "split_profiles").select("profile", "max_chars")
    have = table(spark, d, "chunk_snapshots").select("doc_id").distinct()
    docs = _docs(spark, d).filter("text IS NOT NULL").join(F.broadcast(limits), "profile", "left").join(have, "doc_id", "left_anti")
    p = F.when(F.length("text") > F.col("max_chars"), 0).when(F.col("max_chars").isNotNull(), 1).otherwise(2)
    ranked = docs.select("doc_id", p.alias("priority"), "updated")
    return ranked.orderBy("priority", F.col("updated").desc_nulls_last(), "doc_id").limit(100).select("doc_id", "priority")


def q_recent_pool(spark: SparkSession, d: str) -> DataFrame:
    """Per source the 9 newest documents, 3 of them by hash order."""
    top = W.first_per_group(_docs(spark, d).select("doc_id", "source", "updated"), ["source"], [F.col("updated").desc_nulls_last(), F.col("doc_id")], 9)
    return W.first_per_group(top.drop("rank"), ["source"], [F.sha2(F.concat(F.lit("pool:"), F.col("doc_id").cast("string")), 256)], 3).select("source", "doc_id")


def q_two_level(spark: SparkSession, d: str) -> DataFrame:
    """Ten sources by hash order, three documents of each."""
    h = lambda p, c: F.sha2(F.concat(F.lit(p), F.col(c).cast("string")), 256)
    books = _docs(spark, d).filter("source IS NOT NULL").select("source").distinct().orderBy(h("book:", "source")).limit(10)
    docs = _docs(spark, d).select("doc_id", "source").join(books, "source")
    return W.first_per_group(docs, ["source"], [h("doc:", "doc_id")], 3).select("source", "doc_id")


def q_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The strategy of a document's day: day number since year 1, modulo 4."""
    n = F.datediff(F.to_date("updated"), F.lit("0001-01-01").cast("date")) + 1
    return _docs(spark, d).filter("updated IS NOT NULL").groupBy(F.pmod(n, F.lit(4)).alias("strategy")).agg(F.count("*").alias("documents"))


def q_best_passage(spark: SparkSession, d: str) -> DataFrame:
    """Per site the page with the longest content, the earliest of equals."""
    p = table(spark, d, "crawled_items").filter("content IS NOT NULL AND site IS NOT NULL")
    return p.groupBy("site").agg(F.min_by("item_id", F.struct(-F.length("content"), F.col("item_id"))).alias("item_id"))


def q_source_family(spark: SparkSession, d: str) -> DataFrame:
    """Pages per family: site and title without part suffixes, in lower case."""
    p = table(spark, d, "crawled_items").filter("title IS NOT NULL")
    return p.groupBy(F.lower(F.concat_ws("/", F.coalesce("site", F.lit("")), T.strip_part_suffix(F.col("title")))).alias("family")).agg(F.count("*").alias("pages"), F.countDistinct("item_id").alias("items")).filter("pages > 1")


def q_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """Fragments of twelve characters that begin exactly one title."""
    t = table(spark, d, "crawled_items").filter("length(title) >= 12").select("title").distinct()
    return t.groupBy(F.substring("title", 1, 12).alias("fragment")).agg(F.count("*").alias("n"), F.min("title").alias("title")).filter("n = 1").select("fragment", "title")


def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Removals that were replacements: recorded again within a day of the pruning."""
    p = table(spark, d, "prune_log").select(F.lower(F.trim("table_name")).alias("table_name"), clean_id("record_id").alias("id"), "pruned_at").distinct()
    seen = table(spark, d, "runs").select(F.lit("runs").alias("table_name"), clean_id("run_id").alias("id"), "ingested_at").unionByName(table(spark, d, "llm_calls").select(F.lit("llm_calls").alias("table_name"), clean_id("trace_id").alias("id"), "ingested_at"))
    j = p.join(seen, ["table_name", "id"], "left").withColumn("soon", (F.col("ingested_at") > F.col("pruned_at")) & (F.col("ingested_at") <= F.col("pruned_at") + F.make_dt_interval(F.lit(1))))
    each = j.groupBy("table_name", "id", "pruned_at").agg(F.max(F.coalesce("soon", F.lit(False))).alias("replaced"))
    return each.groupBy("table_name", "replaced").agg(F.count("*").alias("n"))


def q_index_sync(spark: SparkSession, d: str) -> DataFrame:
    """Union of current and annotated entries: documents with text, and those with recorded pieces."""
    now = _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.lit(True).alias("current"))
    noted = table(spark, d, "chunk_snapshots").groupBy("doc_id").agg(F.countDistinct("chunk_index").alias("pieces"))
    return now.join(noted, "doc_id", "full_outer").select("doc_id", F.coalesce("current", F.lit(False)).alias("current"), F.coalesce("pieces", F.lit(0)).alias("pieces"))


def q_normal_key(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval queries by normalised key: trimmed, lower, blanks collapsed; how many spellings each has."""
    q = table(spark, d, "retrieval_events").filter("trim(query_text) != ''")
    return q.groupBy(F.lower(F.trim(F.regexp_replace("query_text", "\\s+", " "))).alias("key")).agg(F.countDistinct("query_text").alias("spellings"), F.count("*").alias("n"))


def q_replay_key(spark: SparkSession, d: str) -> DataFrame:
    """Chronological keys of paths: their digits padded to fourteen."""
    k = F.rpad(F.substring(F.regexp_replace("path", "\\D", ""), 1, 14), 14, "0")
    return _a(spark, d).filter("path IS NOT NULL").select("artifact_id", k.alias("key")).distinct()


def q_audit_records(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed records of verdicts."""
    digest = F.sha2(F.concat_ws("|", "artifact_id", F.coalesce("run_id", F.lit("")), F.coalesce("quality_verdict", F.lit(""))), 256)
    return _a(spark, d).filter("quality_verdict IS NOT NULL").select(digest.alias("audit_id"), "artifact_id").distinct()


def q_verdict_contract(spark: SparkSession, d: str) -> DataFrame:
    """Broken verdicts: not in the enumeration, a score out of range, or a rejection with a high score."""
    v = F.col("quality_verdict")
    why = F.when(v.isNotNull() & ~v.isin("keep", "revise", "reject", "unparseable", "error"), "enum").when((F.col("quality_score") < 0) | (F.col("quality_score") > 10), "range").when((v == "reject") & (F.col("quality_score") > 8), "contradiction")
    return _a(spark, d).select("artifact_id", why.alias("problem")).filter("problem IS NOT NULL")


def q_quote_offset(spark: SparkSession, d: str) -> DataFrame:
    """Where a page's title stands in its content, 0-based; -1 where it doesn't."""
    p = table(spark, d, "crawled_items").filter("title IS NOT NULL AND content IS NOT NULL").select("item_id", "title", "content").distinct()
    return p.select("item_id", (F.expr("locate(title, content)") - 1).alias("at")).distinct()


def q_pair_order(spark: SparkSession, d: str) -> DataFrame:
    """Calls that follow one another in a run, as unordered pairs of stages with their counts."""
    c = table(spark, d, "llm_calls").select("trace_id", clean_id("run_id").alias("run_id"), "ts", F.coalesce("stage", F.lit("unknown")).alias("stage")).filter("run_id IS NOT NULL AND ts IS NOT NULL").dropDuplicates(["trace_id"])
    c = c.withColumn("p", F.lag("stage").over(Window.partitionBy("run_id").orderBy("ts", "trace_id"))).filter("p IS NOT NULL")
    return c.groupBy(F.least("stage", "p").alias("a"), F.greatest("stage", "p").alias("b")).agg(F.count("*").alias("n"))


def q_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """Runs as claims: each kind of artifact is an insight, one whose trace is the run's own id an echo."""
    a = _a(spark, d).filter("run_id IS NOT NULL AND artifact_type IS NOT NULL")
    return consolidate(a.select(F.col("run_id").alias("claim_id"), F.col("artifact_type").alias("insight"), F.array("trace_id").alias("grounded_on")))


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_A = "a AS (SELECT DISTINCT artifact_id, nullif(lower(trim(run_id)), '') AS run_id, nullif(lower(trim(trace_id)), '') AS trace_id, ts, path, artifact_type, quality_verdict, quality_score FROM artifacts)"
_KEY = r"CASE WHEN regexp_extract(path, '(\d+)', 1) = '' THEN lower(path) ELSE lower(regexp_extract(path, '^(\D*)', 1) || lpad(regexp_extract(path, '(\d+)', 1), 12, '0') || regexp_extract(path, '^\D*\d+(.*)$', 1)) END"
SQL = {
    "q_candidates": f"WITH {_A} SELECT artifact_id FROM a WHERE quality_verdict <> 'reject' AND coalesce(quality_score, 5) >= 5",
    "q_exclusions": "SELECT * FROM (SELECT doc_id, CASE WHEN coalesce(path, '') = '' THEN 'untitled' WHEN contains(lower(path), 'report') THEN 'own_report' WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' END AS reason FROM documents) WHERE reason IS NOT NULL",
    "q_distance_gate": "SELECT CASE WHEN top_k IS NULL THEN 'unknown' WHEN top_k <= 5 THEN 'near' ELSE 'far' END AS gate, count(*) AS n FROM retrieval_events GROUP BY 1",
    "q_active_evidence": f"WITH {_A} SELECT run_id, count(*)::INTEGER AS evidence, sum((coalesce(quality_verdict, '') <> 'reject')::INT)::INTEGER AS active FROM a WHERE run_id IS NOT NULL GROUP BY 1",
    "q_tensions": f"WITH {_A}, g AS (SELECT run_id, sum(coalesce(quality_verdict = 'reject', false)::INT) AS against, count(*) AS n, round(avg(quality_score), 9) AS score FROM a WHERE run_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN against > 0 THEN 'contradicted' WHEN n <= 1 THEN 'thin' WHEN score >= 8 THEN 'dogmatic' ELSE 'calm' END AS tension, count(*) AS runs, sum(n)::BIGINT AS evidence FROM g GROUP BY 1",
    "q_falsification": f"WITH {_A} SELECT run_id, count(*) AS n FROM a WHERE quality_verdict = 'reject' AND run_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT artifact_type) >= 2 AND max(ts) <= (SELECT max(ts) FROM a) - INTERVAL 14 DAY",
    "q_quarantine": "WITH d AS (SELECT user_id, ts, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'purchase')), o AS (SELECT user_id, max(ts) AS ok FROM d WHERE NOT failed GROUP BY 1) SELECT user_id, count(*) AS fails, (SELECT max(ts) FROM d) - max(ts) < INTERVAL 7 DAY AS blocked FROM d LEFT JOIN o USING (user_id) WHERE failed AND (ok IS NULL OR ts > ok) GROUP BY 1 HAVING count(*) >= 3",
    "q_thin_rotation": f"WITH {_A} SELECT run_id FROM a WHERE run_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1 ORDER BY max(ts) NULLS FIRST, run_id LIMIT 25",
    "q_readiness": f"WITH {_A}, r AS (SELECT nullif(lower(trim(run_id)), '') AS run_id, max(CASE WHEN error IS NOT NULL THEN 25 ELSE 0 END) AS p FROM runs GROUP BY 1), m AS (SELECT run_id, sum(p) AS more FROM (SELECT nullif(lower(trim(run_id)), '') AS run_id, 10 AS p FROM llm_calls WHERE status = 'failed' UNION ALL SELECT run_id, 15 FROM a WHERE quality_verdict = 'unparseable') GROUP BY 1), s AS (SELECT run_id, greatest(0, 100 - p - coalesce(more, 0))::BIGINT AS score FROM r LEFT JOIN m USING (run_id)) SELECT run_id, score, CASE WHEN score >= 80 THEN 'ready' WHEN score >= 50 THEN 'caution' ELSE 'blocked' END AS verdict FROM s",
    "q_median_scores": f"WITH {_A} SELECT artifact_type, round(median(coalesce(quality_score, 0.0::DOUBLE)), 6) AS median, count(*) AS n FROM a GROUP BY 1",
    "q_findings": r"SELECT lower(trim(regexp_replace(error, '\s+', ' ', 'g'))) AS finding, count(*) AS n, count(DISTINCT stage) AS stages FROM llm_calls WHERE error IS NOT NULL GROUP BY 1 ORDER BY n DESC, finding LIMIT 12",
    "q_round_scores": "WITH r AS (SELECT run_id, intent, max(agent) AS agent, max(date_diff('microsecond', started_at, ended_at)) AS us FROM runs WHERE intent IS NOT NULL GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY us DESC NULLS LAST, run_id DESC) AS n FROM r) SELECT intent, count(*) AS runs, count(DISTINCT agent) AS agents, max(CASE WHEN n = 1 THEN run_id END) AS longest FROM o GROUP BY 1",
    "q_thesis": "SELECT doc_id, arg_min(section_path[1], (char_start, section_path[1])) AS thesis FROM chunk_snapshots WHERE len(section_path) > 0 GROUP BY 1",
    "q_natural_key": f"SELECT doc_id, {_KEY} AS key FROM documents WHERE path IS NOT NULL",
    "q_representative": f"WITH k AS (SELECT doc_id, path, updated, {_KEY} AS key FROM documents WHERE path IS NOT NULL) SELECT regexp_extract(path, '^(.*)/', 1) AS folder, arg_min(doc_id, (key, doc_id)) AS doc_id, strftime(max(updated) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS newest FROM k GROUP BY 1",
    "q_backfill_queue": "SELECT doc_id, priority FROM (SELECT doc_id, updated, (CASE WHEN length(text) > max_chars THEN 0 WHEN max_chars IS NOT NULL THEN 1 ELSE 2 END)::INTEGER AS priority FROM documents LEFT JOIN split_profiles USING (profile) WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM chunk_snapshots WHERE doc_id IS NOT NULL)) ORDER BY priority, updated DESC NULLS LAST, doc_id LIMIT 100",
    "q_recent_pool": "WITH t AS (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY updated DESC NULLS LAST, doc_id) <= 9) SELECT source, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('pool:' || doc_id)) <= 3",
    "q_two_level": "WITH b AS (SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY sha256('book:' || source) LIMIT 10) SELECT source, doc_id FROM documents WHERE source IN (SELECT source FROM b) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('doc:' || doc_id)) <= 3",
    "q_rotation": "SELECT ((date_diff('day', DATE '0001-01-01', (updated AT TIME ZONE 'UTC')::DATE) + 1) % 4)::INTEGER AS strategy, count(*) AS documents FROM documents WHERE updated IS NOT NULL GROUP BY 1",
    "q_best_passage": "SELECT site, arg_min(item_id, (-length(content), item_id)) AS item_id FROM crawled_items WHERE content IS NOT NULL AND site IS NOT NULL GROUP BY 1",
    "q_source_family": r"SELECT lower(coalesce(site, '') || '/' || regexp_replace(title, '(?i)\s*\((part \d+|synthesis|stitched)\)\s*$', '')) AS family, count(*) AS pages, count(DISTINCT item_id) AS items FROM crawled_items WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "q_prefix_match": "SELECT substr(title, 1, 12) AS fragment, min(title) AS title FROM (SELECT DISTINCT title FROM crawled_items WHERE length(title) >= 12) GROUP BY 1 HAVING count(*) = 1",
    "q_reconcile": "WITH p AS (SELECT DISTINCT lower(trim(table_name)) AS table_name, lower(trim(record_id)) AS id, pruned_at FROM prune_log), s AS (SELECT 'runs' AS table_name, lower(trim(run_id)) AS id, ingested_at FROM runs UNION ALL SELECT 'llm_calls', lower(trim(trace_id)), ingested_at FROM llm_calls), e AS (SELECT table_name, id, pruned_at, bool_or(coalesce(ingested_at > pruned_at AND ingested_at <= pruned_at + INTERVAL 1 DAY, false)) AS replaced FROM p LEFT JOIN s USING (table_name, id) GROUP BY 1, 2, 3) SELECT table_name, replaced, count(*) AS n FROM e GROUP BY 1, 2",
    "q_index_sync": "WITH n AS (SELECT doc_id, count(DISTINCT chunk_index) AS pieces FROM chunk_snapshots GROUP BY 1), d AS (SELECT doc_id, true AS current FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(current, false) AS current, coalesce(pieces, 0) AS pieces FROM d FULL JOIN n USING (doc_id)",
    "q_normal_key": r"SELECT lower(trim(regexp_replace(query_text, '\s+', ' ', 'g'))) AS key, count(DISTINCT query_text) AS spellings, count(*) AS n FROM retrieval_events WHERE trim(query_text) <> '' GROUP BY 1",
    "q_replay_key": rf"WITH {_A} SELECT DISTINCT artifact_id, rpad(substr(regexp_replace(path, '\D', '', 'g'), 1, 14), 14, '0') AS key FROM a WHERE path IS NOT NULL",
    "q_audit_records": f"WITH {_A} SELECT DISTINCT sha256(concat_ws('|', artifact_id, coalesce(run_id, ''), quality_verdict)) AS audit_id, artifact_id FROM a WHERE quality_verdict IS NOT NULL",
    "q_verdict_contract": f"WITH {_A} SELECT * FROM (SELECT artifact_id, CASE WHEN quality_verdict NOT IN ('keep', 'revise', 'reject', 'unparseable', 'error') THEN 'enum' WHEN quality_score < 0 OR quality_score > 10 THEN 'range' WHEN quality_verdict = 'reject' AND quality_score > 8 THEN 'contradiction' END AS problem FROM a) WHERE problem IS NOT NULL",
    "q_quote_offset": "SELECT DISTINCT item_id, (strpos(content, title) - 1)::INTEGER AS at FROM crawled_items WHERE title IS NOT NULL AND content IS NOT NULL",
    "q_consolidate": f"WITH {_A}, o AS (SELECT run_id AS claim_id, artifact_type AS insight, count(*) AS n, min(coalesce(trace_id = run_id, false)::INT) AS echo FROM a WHERE run_id IS NOT NULL AND artifact_type IS NOT NULL GROUP BY 1, 2) SELECT claim_id, round(least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (count(*) - sum(echo))), 4) AS confidence, count(*) AS insights, sum(echo)::BIGINT AS echoes, sum(n - 1)::BIGINT AS revisions FROM o GROUP BY 1",
    "q_pair_order": "WITH c AS (SELECT trace_id, any_value(lower(trim(run_id))) AS run_id, any_value(ts) AS ts, any_value(coalesce(stage, 'unknown')) AS stage FROM llm_calls WHERE trim(run_id) <> '' AND ts IS NOT NULL GROUP BY 1), p AS (SELECT stage, lag(stage) OVER (PARTITION BY run_id ORDER BY ts, trace_id) AS p FROM c) SELECT least(stage, p) AS a, greatest(stage, p) AS b, count(*) AS n FROM p WHERE p IS NOT NULL GROUP BY 1, 2",
}
