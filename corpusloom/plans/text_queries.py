"""Queries over the documents, pages and chunks: joins, sets and scalar text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.ids import clean_id
from corpusloom.operators import joins as J
from corpusloom.sources.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_snapshots").distinct()


def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents that have no file (path) any more; a null document id is an orphan."""
    c = _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return c.join(_docs(spark, d).filter("path IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def q_index_health(spark: SparkSession, d: str) -> DataFrame:
    """Documents over their limit against the documents with recorded pieces."""
    over = _docs(spark, d).join(F.broadcast(table(spark, d, "split_profiles").select("profile", "max_chars")), "profile").filter(F.length("text") > F.col("max_chars"))
    return J.index_health(over.select("doc_id"), _chunks(spark, d).select("doc_id"), "doc_id")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("target"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """File names of the documents without folder and extension, as titles."""
    return _docs(spark, d).filter("path IS NOT NULL").select("doc_id", F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "\\.[A-Za-z0-9]+$", "").alias("title"))


def q_link_lint(spark: SparkSession, d: str) -> DataFrame:
    """Link targets that no title has, with their number of links."""
    t = _titles(spark, d).select(F.lower("title").alias("k")).distinct()
    return _links(spark, d).withColumn("k", F.lower("target")).join(t, "k", "left_anti").groupBy("target").agg(F.count("*").alias("links"))


def q_groundedness(spark: SparkSession, d: str) -> DataFrame:
    """Valid links over links; 1 for a document without any."""
    known = _titles(spark, d).select(F.lower("title").alias("k")).distinct().withColumn("ok", F.lit(1))
    per = _links(spark, d).withColumn("k", F.lower("target")).join(known, "k", "left").groupBy("doc_id").agg((F.sum(F.coalesce("ok", F.lit(0))) / F.count("*")).alias("g"))
    return _docs(spark, d).select("doc_id").join(per, "doc_id", "left").select("doc_id", F.round(F.coalesce("g", F.lit(1.0)), 6).alias("groundedness"))


def q_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Recorded pieces that overlap the windows of 1,000 characters of their document, first window per piece."""
    pieces = _chunks(spark, d).filter("char_end > char_start").select("doc_id", "chunk_index", F.col("char_start").alias("start"), F.col("char_end").alias("end"))
    windows = _docs(spark, d).filter("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_chars") - 1) / 1000))).alias("w"))
    windows = windows.select("doc_id", "w", (F.col("w") * 1000).alias("start"), (F.col("w") * 1000 + 1000).alias("end"))
    both = J.overlaps(pieces, windows, "doc_id", 1000)
    return both.groupBy("doc_id", F.col("a_chunk_index").alias("chunk_index")).agg(F.min("b_w").alias("first_window"), F.count("*").alias("windows"))


def q_asof(spark: SparkSession, d: str) -> DataFrame:
    """For each purchase the user's last click strictly before it."""
    e = table(spark, d, "events")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", "event_id")
    return J.as_of(buys, clicks, "user_id", "ts", "ts", F.struct("ts", "event_id"), "c").select("event_id", F.date_format("c.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_click"))


def q_title_match(spark: SparkSession, d: str) -> DataFrame:
    """Page titles in small letters against the titles of pages: as they are without a text, stitched without a snippet, else a synthesis."""
    items = table(spark, d, "crawled_items").filter("title IS NOT NULL")
    asked = items.select(F.lower("title").alias("title")).distinct()
    end = F.when(F.coalesce("content", F.lit("")) == "", "").when(F.coalesce("snippet", F.lit("")) == "", " (Stitched)").otherwise(" (Synthesis)")
    heads = items.select(F.concat("title", end).alias("title")).distinct()
    return J.best_title(asked, heads)


def q_sym_edges(spark: SparkSession, d: str) -> DataFrame:
    """Calls of one run to one another by parent, as symmetric edges; degree per node."""
    c = table(spark, d, "llm_calls").select(clean_id("trace_id").alias("src"), clean_id("parent_trace_id").alias("dst"))
    return J.symmetric(c).groupBy("src").agg(F.count("*").alias("degree"))


def q_lineage(spark: SparkSession, d: str) -> DataFrame:
    """How many ancestors each run has within 8 steps, and the farthest."""
    from corpusloom.operators.hierarchy import parent_links

    links = parent_links(table(spark, d, "runs"), "run_id", "parent_run_id", "ingested_at")
    known = links.join(links.select(F.col("node").alias("parent")), "parent", "left_semi")
    return J.ancestors(known).groupBy("node").agg(F.count("*").alias("ancestors"), F.max("distance").alias("farthest"))


def q_independent_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of a run's retrievals, those named like the event's own id left out."""
    from corpusloom.plans.event_queries import _RESULTS

    r = table(spark, d, "retrieval_events").select(clean_id("run_id").alias("run_id"), "retrieval_id", F.explode(F.from_json("results_json", _RESULTS)).alias("r"))
    return r.filter("run_id IS NOT NULL AND r.id IS NOT NULL AND r.id != retrieval_id").groupBy("run_id").agg(F.countDistinct("r.source").alias("sources"), F.countDistinct("r.id").alias("documents"))


def _digest() -> F.Column:
    return T.content_hash(F.col("text"), F.col("source"), F.col("profile"))


def q_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _digest().alias("content_hash"))


def q_changed_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the index of those without CRLF, which hold the hash of their unchanged text."""
    docs = _docs(spark, d)
    now = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    then = docs.filter("text IS NOT NULL").select("doc_id", F.sha2(F.regexp_replace("text", "\r\n", "\n"), 256).alias("h"))
    return J.changed(now, then, "doc_id", "h")


def q_tag_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Inline tags of the texts, normalised, with the number of documents."""
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(#[A-Za-z][A-Za-z0-9_/-]*)"), F.lit(1))
    t = _docs(spark, d).select("doc_id", F.explode(T.normalize_tags(raw)).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("documents"))


def q_tag_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Distinct result titles two consecutive retrievals of a run share, over their union."""
    from pyspark.sql import Window

    from corpusloom.plans.event_queries import _RESULTS

    r = table(spark, d, "retrieval_events").select("retrieval_id", clean_id("run_id").alias("run_id"), "ts", F.array_distinct(F.transform(F.from_json("results_json", _RESULTS), lambda x: x.title)).alias("t")).filter("run_id IS NOT NULL AND t IS NOT NULL").dropDuplicates(["retrieval_id"])
    r = r.withColumn("p", F.lag("t").over(Window.partitionBy("run_id").orderBy("ts", "retrieval_id"))).filter("p IS NOT NULL")
    union = F.size(F.array_union("t", "p"))
    return r.select("retrieval_id", F.round(F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("t", "p")) / union), 6).alias("jaccard"))


def q_url_canon(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "crawled_items")
    return p.select("item_id", T.canonical_url(F.col("url")).alias("url")).distinct()


def q_route_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_items").groupBy(T.route_source(F.coalesce("url", F.lit(""))).alias("parser"), "target").agg(F.count("*").alias("n"))


def q_section_refs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(T.section_refs(F.coalesce("text", F.lit(""))), ",").alias("refs")).filter("refs != ''")


def q_script_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Share of characters in foreign scripts; flagged unless above 2 percent."""
    n = F.regexp_count("text", F.lit(T.FOREIGN))
    r = _docs(spark, d).filter("text != ''").select("doc_id", n.alias("n"), (n / F.length("text")).alias("share"))
    return r.select("doc_id", F.round("share", 6).alias("share"), ((F.col("n") > 0) & (F.col("share") <= 0.02)).alias("flagged"))


def q_zero_width(spark: SparkSession, d: str) -> DataFrame:
    """Zero-width characters that a cleanup would strip."""
    return _docs(spark, d).select("doc_id", F.regexp_count("text", F.lit("[​‌‍﻿]")).alias("n")).filter("n > 0")


def q_text_quality(spark: SparkSession, d: str) -> DataFrame:
    """Hard issues of a body: empty, odd fences, HTML headings."""
    t = F.coalesce(F.col("text"), F.lit(""))
    empty = F.regexp_replace(t, "[ \t\r\n]", "") == ""
    return _docs(spark, d).select("doc_id", empty.alias("empty_body"), (F.regexp_count(t, F.lit("```")) % 2 == 1).alias("odd_fences"), t.rlike("(?i)</?h[1-6][ >]").alias("html_heading"))


def q_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which one character stands forty times in a row."""
    return _docs(spark, d).filter(T.has_repeat_of_40(F.col("text"))).select("doc_id")


def q_language_route(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.route_language(F.col("text")).alias("route"))


def q_number_fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a response that its prompt doesn't hold."""
    c = table(spark, d, "llm_calls").select("trace_id", "prompt_text", "response_text").distinct()
    return c.select("trace_id", F.size(F.array_except(T.numbers(F.col("response_text")), T.numbers(F.col("prompt_text")))).alias("unfounded")).filter("unfounded > 0")


def q_quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of a response that stand in its prompt, and keep or revise by a share of 0.8."""
    c = table(spark, d, "llm_calls").select("trace_id", "prompt_text", "response_text").distinct()
    q = F.regexp_extract_all(F.coalesce("response_text", F.lit("")), F.lit("“([^”\\n]{4,})”"), F.lit(1))
    c = c.withColumn("q", q).filter(F.size("q") > 0).withColumn("ok", F.size(F.filter("q", lambda x: F.instr(F.col("prompt_text"), x) > 0)))
    return c.select("trace_id", F.size("q").alias("quotes"), F.col("ok").alias("grounded"), F.when(F.col("ok") / F.size("q") >= 0.8, "keep").otherwise("revise").alias("verdict"))


def q_retained(spark: SparkSession, d: str) -> DataFrame:
    """Share of a page's distinct snippet lines that its content holds."""
    p = table(spark, d, "crawled_items").select("item_id", "snippet", "content").filter("snippet IS NOT NULL AND content IS NOT NULL").distinct()
    lines = F.array_distinct(F.filter(F.split("snippet", "\n"), lambda x: F.trim(x) != ""))
    p = p.withColumn("l", lines).filter(F.size("l") > 0)
    return p.select("item_id", F.round(F.size(F.filter("l", lambda x: F.contains(F.col("content"), x))) / F.size("l"), 6).alias("retained")).distinct()


def q_doc_key(spark: SparkSession, d: str) -> DataFrame:
    """Title identities: without a trailing bracket, as a slug, as a file name."""
    p = table(spark, d, "crawled_items").filter("title IS NOT NULL").select("title").distinct()
    return p.select("title", T.document_key(F.col("title")).alias("doc_key"), T.slug(F.col("title")).alias("slug"), T.file_stem(F.col("title")).alias("stem"))


def q_line_of(spark: SparkSession, d: str) -> DataFrame:
    """The line a recorded piece starts in."""
    c = _chunks(spark, d).join(_docs(spark, d).select("doc_id", "text"), "doc_id").filter("char_start <= length(text)")
    return c.select("doc_id", "chunk_index", (F.regexp_count(F.expr("substring(text, 1, char_start)"), F.lit("\n")) + 1).alias("line")).distinct()


def q_stitch(spark: SparkSession, d: str) -> DataFrame:
    """Pieces put together in order: number, total size and a hash of the kinds of their ends."""
    c = _chunks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "char_start", "boundary_type", "size"))).alias("p"))
    return c.select("doc_id", F.size("p").alias("pieces"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x.size).alias("size"), F.sha2(F.array_join(F.transform("p", lambda x: x.boundary_type), ","), 256).alias("ends"))


def q_split_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose recorded indexes run from 0 without gaps and whose starts ascend."""
    c = _chunks(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "char_start"))).alias("p"))
    dense = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("p", i).chunk_index == i)
    rising = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | (F.get("p", i).char_start > F.get("p", i - 1).char_start))
    return c.select("doc_id", dense.alias("dense"), rising.alias("rising"))


def q_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facets of a document: its distinct headings of at least 8 characters, 8 at most."""
    c = _chunks(spark, d).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("section_path")))).alias("h"))
    kept = F.slice(F.filter("h", lambda x: F.length(x) >= 8), 1, 8)
    return c.select("doc_id", F.posexplode(kept).alias("facet_index", "text"))


def q_verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    """One-word verdicts of responses, normalised and ranked."""
    v = F.lower(F.regexp_extract(F.trim("response_text"), "(?i)^(supported|refuted|unclear)\\.?$", 1))
    c = table(spark, d, "llm_calls").select("trace_id", v.alias("verdict")).filter("verdict != ''")
    return c.groupBy("verdict").agg(F.count("*").alias("n"), F.max(F.when(F.col("verdict") == "supported", 2).when(F.col("verdict") == "unclear", 1).otherwise(0)).alias("rank"))


def q_supersede(spark: SparkSession, d: str) -> DataFrame:
    """A run's artifacts as an array of evidence; all but the newest of each type are superseded, the active ones counted."""
    a = table(spark, d, "artifacts").filter("trim(run_id) != '' AND artifact_type IS NOT NULL").select(clean_id("run_id").alias("run_id"), "artifact_id", "artifact_type", "ts").distinct()
    newest = a.groupBy("run_id", "artifact_type").agg(F.max(F.struct("ts", "artifact_id")).alias("m"), F.count("*").alias("n"))
    return newest.groupBy("run_id").agg(F.sum("n").alias("evidence"), F.count("*").alias("active"), F.sum(F.col("n") - 1).alias("superseded"))


def q_sections(spark: SparkSession, d: str) -> DataFrame:
    """Top folders of the paths with documents and the newest update; names that begin with a mark are skipped."""
    top = F.regexp_extract("path", "^/*([^/]+)/", 1)
    p = _docs(spark, d).filter("path IS NOT NULL").select(top.alias("section"), "updated").filter("section != '' AND NOT section LIKE '.%' AND NOT substring(section, 1, 1) = '_'")
    return p.groupBy("section").agg(F.count("*").alias("documents"), F.date_format(F.max("updated"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


def q_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose recorded sizes mostly don't fall from piece to piece."""
    from pyspark.sql import Window

    c = _chunks(spark, d).withColumn("p", F.lag("size").over(Window.partitionBy("doc_id").orderBy("chunk_index", "char_start"))).filter("p IS NOT NULL")
    return c.groupBy("doc_id").agg(F.round(F.avg(F.when(F.col("size") >= F.col("p"), 1.0).otherwise(0.0)), 6).alias("share")).filter("share >= 0.8")


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_C = "c AS (SELECT DISTINCT * FROM chunk_snapshots)"
_LINK = r"links AS (SELECT doc_id, trim(unnest(regexp_extract_all(coalesce(text, ''), '\[\[([^\[\]|#\n]+)', 1))) AS target FROM documents), titles AS (SELECT DISTINCT lower(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[A-Za-z0-9]+$', '')) AS k FROM documents WHERE path IS NOT NULL)"
_RES = "CASE WHEN json_valid(results_json) THEN from_json(results_json, '[{\"id\":\"VARCHAR\",\"title\":\"VARCHAR\",\"source\":\"VARCHAR\"}]') END"
_NORM = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"
SQL = {
    "q_orphans": f"WITH {_C} SELECT doc_id, count(*) AS chunks FROM c WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE path IS NOT NULL) GROUP BY 1",
    "q_index_health": "WITH o AS (SELECT DISTINCT doc_id FROM documents JOIN split_profiles USING (profile) WHERE length(text) > max_chars), i AS (SELECT DISTINCT doc_id FROM chunk_snapshots) SELECT doc_id, 'unindexed' AS state FROM o WHERE doc_id NOT IN (SELECT doc_id FROM i) UNION ALL SELECT doc_id, 'stale' FROM i WHERE doc_id NOT IN (SELECT doc_id FROM o)",
    "q_link_lint": f"WITH {_LINK} SELECT target, count(*) AS links FROM links WHERE lower(target) NOT IN (SELECT k FROM titles) GROUP BY 1",
    "q_groundedness": f"WITH {_LINK}, g AS (SELECT doc_id, avg((lower(target) IN (SELECT k FROM titles))::INT) AS g FROM links GROUP BY 1) SELECT doc_id, round(coalesce(g, 1.0::DOUBLE), 6) AS groundedness FROM documents LEFT JOIN g USING (doc_id)",
    "q_interval_join": f"WITH {_C}, p AS (SELECT * FROM c WHERE char_end > char_start) SELECT p.doc_id, chunk_index, min(w) AS first_window, count(*) AS windows FROM p JOIN (SELECT doc_id, unnest(range(0, (n_chars - 1) // 1000 + 1)) AS w FROM documents WHERE n_chars > 0) v ON p.doc_id = v.doc_id AND char_start < w * 1000 + 1000 AND char_end > w * 1000 GROUP BY 1, 2",
    "q_asof": "SELECT b.event_id, strftime((SELECT max(c.ts) FROM events c WHERE c.event_type = 'click' AND c.user_id = b.user_id AND c.ts < b.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_click FROM events b WHERE b.event_type = 'purchase'",
    "q_title_match": f"WITH {_C}, i AS (SELECT * FROM crawled_items WHERE title IS NOT NULL), r AS (SELECT title, {_NORM} AS k FROM (SELECT DISTINCT lower(title) AS title FROM i)), t AS (SELECT title AS match, {_NORM} AS m FROM (SELECT DISTINCT title || CASE WHEN coalesce(content, '') = '' THEN '' WHEN coalesce(snippet, '') = '' THEN ' (Stitched)' ELSE ' (Synthesis)' END AS title FROM i)), s AS (SELECT r.title, t.match, CASE WHEN m = k THEN 100 WHEN m = k || ' (stitched)' THEN 95 WHEN m = k || ' (synthesis)' THEN 90 END AS score FROM r JOIN t ON m IN (k, k || ' (stitched)', k || ' (synthesis)') WHERE k <> '') SELECT title, match, score::INTEGER AS score FROM s QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, match) = 1",
    "q_sym_edges": "WITH e AS (SELECT lower(trim(trace_id)) AS src, lower(trim(parent_trace_id)) AS dst FROM llm_calls WHERE trim(trace_id) <> '' AND trim(parent_trace_id) <> ''), s AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst) SELECT src, count(*) AS degree FROM s GROUP BY 1",
    "q_lineage": "WITH RECURSIVE l AS (SELECT lower(trim(run_id)) AS node, nullif(lower(trim(arg_max(coalesce(parent_run_id, ''), ingested_at))), '') AS parent FROM runs WHERE trim(run_id) <> '' GROUP BY 1), k AS (SELECT * FROM l WHERE parent IN (SELECT node FROM l)), w AS (SELECT node, parent AS ancestor, 1 AS distance, [node, parent] AS seen FROM k UNION ALL SELECT w.node, k.parent, w.distance + 1, list_append(w.seen, k.parent) FROM w JOIN k ON k.node = w.ancestor WHERE w.distance < 8 AND NOT list_contains(w.seen, k.parent)) SELECT node, count(*) AS ancestors, max(distance)::INTEGER AS farthest FROM w GROUP BY 1",
    "q_independent_sources": f"SELECT run_id, count(DISTINCT r.source) AS sources, count(DISTINCT r.id) AS documents FROM (SELECT lower(trim(run_id)) AS run_id, retrieval_id, unnest({_RES}) AS r FROM retrieval_events) WHERE run_id <> '' AND r.id IS NOT NULL AND r.id <> retrieval_id GROUP BY 1",
    "q_content_hash": "SELECT doc_id, sha256(concat_ws(chr(0), coalesce(text, ''), coalesce(source, ''), coalesce(profile, ''))) AS content_hash FROM documents",
    "q_changed_docs": "SELECT doc_id, CASE WHEN text IS NULL THEN 'new' ELSE 'changed' END AS change FROM documents WHERE text IS NULL OR contains(text, chr(13) || chr(10))",
    "q_tag_normalize": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(#[A-Za-z][A-Za-z0-9_/-]*)', 1)) AS tag FROM documents), n AS (SELECT DISTINCT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower(tag)), '^#+', ''), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM t) SELECT tag, count(*) AS documents FROM n WHERE tag <> '' GROUP BY 1",
    "q_tag_jaccard": f"WITH r AS (SELECT retrieval_id, any_value(lower(trim(run_id))) AS run_id, any_value(ts) AS ts, any_value(list_distinct(list_transform({_RES}, lambda x: x.title))) AS t FROM retrieval_events WHERE trim(run_id) <> '' AND {_RES} IS NOT NULL GROUP BY 1), p AS (SELECT *, lag(t) OVER (PARTITION BY run_id ORDER BY ts, retrieval_id) AS p FROM r) SELECT retrieval_id, round(CASE WHEN len(list_distinct(list_concat(t, p))) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p))) END, 6) AS jaccard FROM p WHERE p IS NOT NULL",
    "q_url_canon": r"WITH u AS (SELECT item_id, trim(url) AS u FROM crawled_items), p AS (SELECT item_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS r FROM u) SELECT DISTINCT item_id, CASE WHEN s IN ('http', 'https') AND h <> '' AND NOT contains(h, '@') THEN s || '://' || h || CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END ELSE '' END AS url FROM p",
    "q_route_url": r"WITH p AS (SELECT target, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/:?#]*)', 1)) AS h, regexp_extract(coalesce(url, ''), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM crawled_items) SELECT CASE WHEN h IN ('github.com', 'www.github.com') AND starts_with(p, '/trending') THEN 'github_trending' WHEN h = 'news.ycombinator.com' THEN 'hackernews' WHEN h IN ('arxiv.org', 'www.arxiv.org', 'export.arxiv.org') AND starts_with(p, '/list/') THEN 'arxiv' ELSE 'feed' END AS parser, target, count(*) AS n FROM p GROUP BY 1, 2",
    "q_script_ratio": r"WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{0e00}-\x{0e7f}\x{0400}-\x{04ff}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{ac00}-\x{d7af}]')) AS n, length(text) AS l FROM documents WHERE text <> '') SELECT doc_id, round(n / l, 6) AS share, n > 0 AND n / l <= 0.02 AS flagged FROM n",
    "q_zero_width": r"SELECT * FROM (SELECT doc_id, len(regexp_extract_all(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]'))::INTEGER AS n FROM documents) WHERE n > 0",
    "q_text_quality": r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t\r\n]', '', 'g') = '' AS empty_body, len(regexp_extract_all(coalesce(text, ''), '```')) % 2 = 1 AS odd_fences, regexp_matches(coalesce(text, ''), '(?i)</?h[1-6][ >]') AS html_heading FROM documents",
    "q_language_route": r"WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]')) AS n, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS l FROM documents) SELECT doc_id, CASE WHEN n = 0 THEN 'en' WHEN n >= 2 OR (l > 0 AND n / l >= 0.2) THEN 'zh' ELSE 'en' END AS route FROM n",
    "q_number_fidelity": r"WITH c AS (SELECT DISTINCT trace_id, prompt_text, response_text FROM llm_calls), n AS (SELECT trace_id, len(list_filter(list_distinct(regexp_extract_all(coalesce(response_text, ''), '\d+')), lambda x: NOT list_contains(regexp_extract_all(coalesce(prompt_text, ''), '\d+'), x)))::INTEGER AS unfounded FROM c) SELECT * FROM n WHERE unfounded > 0",
    "q_quote_grounding": r"WITH c AS (SELECT DISTINCT trace_id, prompt_text, response_text FROM llm_calls), q AS (SELECT trace_id, prompt_text, regexp_extract_all(coalesce(response_text, ''), '“([^”\n]{4,})”', 1) AS q FROM c), g AS (SELECT trace_id, len(q) AS quotes, len(list_filter(q, lambda x: contains(prompt_text, x))) AS grounded FROM q WHERE len(q) > 0) SELECT trace_id, quotes::INTEGER AS quotes, grounded::INTEGER AS grounded, CASE WHEN grounded / quotes >= 0.8 THEN 'keep' ELSE 'revise' END AS verdict FROM g",
    "q_retained": r"WITH p AS (SELECT DISTINCT item_id, content, list_distinct(list_filter(string_split(snippet, chr(10)), lambda x: trim(x) <> '')) AS l FROM crawled_items WHERE snippet IS NOT NULL AND content IS NOT NULL) SELECT DISTINCT item_id, round(len(list_filter(l, lambda x: contains(content, x))) / len(l), 6) AS retained FROM p WHERE len(l) > 0",
    "q_doc_key": r"SELECT DISTINCT title, regexp_replace(trim(title), ' \([^()]*\)$', '') AS doc_key, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(substr(regexp_replace(regexp_replace(regexp_replace(title, '[\\/*?:\x22<>|$\x00-\x1f]', '', 'g'), '\s+', ' ', 'g'), '^[ .-]+|[ .-]+$', '', 'g'), 1, 120), '^[ .-]+|[ .-]+$', '', 'g') AS stem FROM crawled_items WHERE title IS NOT NULL",
    "q_line_of": f"WITH {_C} SELECT DISTINCT c.doc_id, chunk_index, (length(substr(text, 1, char_start)) - length(replace(substr(text, 1, char_start), chr(10), '')) + 1)::INTEGER AS line FROM c JOIN documents d USING (doc_id) WHERE char_start <= length(text)",
    "q_stitch": f"WITH {_C} SELECT doc_id, count(*)::INTEGER AS pieces, sum(size)::BIGINT AS size, sha256(string_agg(boundary_type, ',' ORDER BY chunk_index, char_start, boundary_type, size)) AS ends FROM c GROUP BY 1",
    "q_split_check": f"WITH {_C}, o AS (SELECT doc_id, chunk_index, char_start, row_number() OVER w - 1 AS i, lag(char_start) OVER w AS p FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, char_start)) SELECT doc_id, bool_and(chunk_index = i) AS dense, bool_and(p IS NULL OR char_start > p) AS rising FROM o GROUP BY 1",
    "q_facets": f"WITH {_C}, h AS (SELECT DISTINCT doc_id, unnest(section_path) AS text FROM c), n AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY text) - 1 AS facet_index FROM h WHERE length(text) >= 8) SELECT doc_id, facet_index::INTEGER AS facet_index, text FROM n WHERE facet_index < 8",
    "q_verdict_parse": r"WITH v AS (SELECT lower(regexp_extract(trim(response_text), '(?i)^(supported|refuted|unclear)\.?$', 1)) AS verdict FROM llm_calls) SELECT verdict, count(*) AS n, max(CASE verdict WHEN 'supported' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END)::INTEGER AS rank FROM v WHERE verdict <> '' GROUP BY 1",
    "q_supersede": "WITH a AS (SELECT DISTINCT lower(trim(run_id)) AS run_id, artifact_id, artifact_type, ts FROM artifacts WHERE trim(run_id) <> '' AND artifact_type IS NOT NULL) SELECT run_id, count(*) AS evidence, count(DISTINCT artifact_type) AS active, count(*) - count(DISTINCT artifact_type) AS superseded FROM a GROUP BY 1",
    "q_sections": "WITH p AS (SELECT regexp_extract(path, '^/*([^/]+)/', 1) AS section, updated FROM documents WHERE path IS NOT NULL) SELECT section, count(*) AS documents, strftime(max(updated) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS newest FROM p WHERE section <> '' AND section NOT LIKE '.%' AND section[1] <> '_' GROUP BY 1",
    "q_monotone": f"WITH {_C}, s AS (SELECT doc_id, size, lag(size) OVER (PARTITION BY doc_id ORDER BY chunk_index, char_start) AS p FROM c) SELECT * FROM (SELECT doc_id, round(avg((size >= p)::INT), 6) AS share FROM s WHERE p IS NOT NULL GROUP BY 1) WHERE share >= 0.8",
}
