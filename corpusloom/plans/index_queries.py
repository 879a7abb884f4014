"""Queries over ids, labels, tags, titles and tallies of the index, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.sources.tables import spread, table

#: Scripts without an alphabet of their own keys (ideographs, kana, hangul).
_CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"


def tag_key(tag: Column) -> Column:
    """A tag as a column name: small letters, what is no letter or digit as one underscore each, a prefix."""
    return F.concat(F.lit("tag_"), F.regexp_replace(F.lower(F.trim(tag)), r"[^\p{L}\p{N}]", "_"))


def label_covers(outer: Column, inner: Column) -> Column:
    """Whether a section label covers another: 2 covers 2 and 2.4, not 20."""
    return (inner == outer) | inner.startswith(F.concat(outer, F.lit(".")))


def title_kind(title: Column) -> Column:
    """What a title's suffix tells of a page."""
    t = F.lower(F.trim(title))
    return F.when(t.endswith("(stitched)"), "stitched").when(t.endswith("(synthesis)"), "synthesis").when(t.rlike(r"\(part \d+\)$"), "part").otherwise("page")


def q_tag_keys(spark: SparkSession, d: str) -> DataFrame:
    """Column names of the hashtags, with the number of documents that have them."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    tags = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("#([A-Za-z][A-Za-z0-9_/-]*)"), F.lit(1)))).alias("tag"))
    return tags.groupBy(tag_key(F.col("tag")).alias("key")).agg(F.count_distinct("doc_id").alias("documents"))


def q_bilingual(spark: SparkSession, d: str) -> DataFrame:
    """Distinct page titles with ideographs, kana or hangul, which become aliases, and those without, per site."""
    t = table(spark, d, "crawled_items").filter("title IS NOT NULL AND site IS NOT NULL").select("site", "title").distinct()
    return t.groupBy("site").agg(F.count_if(F.col("title").rlike(_CJK)).alias("aliases"), F.count_if(~F.col("title").rlike(_CJK)).alias("titles"))


def q_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of documents by path, and of their recorded pieces by place."""
    docs = table(spark, d, "documents").filter("path IS NOT NULL").select("doc_id", F.sha2("path", 256).alias("document_key"))
    c = table(spark, d, "chunk_snapshots").filter("chunk_index IS NOT NULL").select("doc_id", "char_start", "char_end").distinct()
    return c.join(docs, "doc_id").select("document_key", F.concat_ws("_", "document_key", F.lit("chunk"), "char_start", "char_end").alias("chunk_key"))


def q_label_cover(spark: SparkSession, d: str) -> DataFrame:
    """Section labels of a document and how many labels of the document each covers, itself included."""
    heads = table(spark, d, "chunk_snapshots").select("doc_id", F.explode("section_path").alias("h")).select("doc_id", F.regexp_extract("h", r"^(\d+(?:\.\d+)*) ", 1).alias("label")).filter("label != ''").distinct()
    inner = heads.select(F.col("doc_id").alias("d"), F.col("label").alias("inner"))
    return heads.join(inner, (F.col("doc_id") == F.col("d")) & label_covers(F.col("label"), F.col("inner"))).groupBy("doc_id", "label").agg(F.count("*").alias("covered"))


def q_title_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of titles by their suffix; titles without a text are parts, those without a snippet stitched."""
    items = table(spark, d, "crawled_items").filter("title IS NOT NULL")
    end = F.when(F.coalesce("content", F.lit("")) == "", " (Part 2)").when(F.coalesce("snippet", F.lit("")) == "", " (Stitched)").otherwise("")
    return items.select(title_kind(F.concat("title", end)).alias("kind"), "title").groupBy("kind").agg(F.count_distinct("title").alias("titles"))


def q_vector_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 300 usable vectors of the least ids: a bounded sample in a fixed order."""
    e = table(spark, d, "embedding_cache").filter("embedding IS NOT NULL AND size(embedding) = dim AND vec_id IS NOT NULL").select("vec_id").distinct()
    return e.orderBy("vec_id").limit(300)


def q_seed_titles(spark: SparkSession, d: str) -> DataFrame:
    """File names under note and wiki folders that may seed a search: none of the claims, drafts or hidden ones."""
    p = table(spark, d, "documents").filter("path IS NOT NULL")
    name = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    root = F.substring_index("path", "/", 1)
    return p.filter(root.rlike("-(notes|wiki)$") & ~name.rlike("^(claims|draft|_)") & (name != "")).select(root.alias("root"), name.alias("title")).distinct()


def q_quote_tally(spark: SparkSession, d: str) -> DataFrame:
    """Distinct queries, without regard to case and outer blanks, by status."""
    r = table(spark, d, "retrieval_events").filter("trim(query_text) != ''").select(F.lower(F.trim("query_text")).alias("q"), F.coalesce("status", F.lit("unknown")).alias("status")).distinct()
    return r.groupBy("status").agg(F.count("*").alias("queries"))


def q_page_status(spark: SparkSession, d: str) -> DataFrame:
    """Audit roll-up of the runs' statuses with their share."""
    s = table(spark, d, "runs").groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    total = s.agg(F.sum("n").alias("total"))
    return s.join(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def q_source_sections(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at lines of three dashes: number and length of the parts that aren't blank."""
    docs = spread(table(spark, d, "documents").filter("contains(text, '\n---\n')").select("doc_id", "text"))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n---\n"))).filter("trim(col) != ''").select("doc_id", F.col("pos").alias("part"), F.length("col").alias("chars"))


def q_token_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of tokens per source, and the longest text's."""
    docs = spread(table(spark, d, "documents").select("source", "text"))
    n = F.size(T.tokens(F.col("text")))
    return docs.groupBy("source").agg(F.round(F.avg(n), 4).alias("mean_tokens"), F.max(n).alias("most_tokens"))


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[\x{4e00}-\x{9fff}]')"
SQL = {
    "q_tag_keys": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '#([A-Za-z][A-Za-z0-9_/-]*)', 1)) AS tag FROM documents) SELECT 'tag_' || regexp_replace(lower(trim(tag)), '[^\p{L}\p{N}]', '_', 'g') AS key, count(DISTINCT doc_id) AS documents FROM t GROUP BY 1",
    "q_bilingual": r"SELECT site, count(*) FILTER (regexp_matches(title, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]')) AS aliases, count(*) FILTER (NOT regexp_matches(title, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]')) AS titles FROM (SELECT DISTINCT site, title FROM crawled_items WHERE title IS NOT NULL AND site IS NOT NULL) GROUP BY 1",
    "q_ids": "SELECT sha256(path) AS document_key, sha256(path) || '_chunk_' || char_start || '_' || char_end AS chunk_key FROM (SELECT DISTINCT doc_id, char_start, char_end FROM chunk_snapshots WHERE chunk_index IS NOT NULL) JOIN documents USING (doc_id) WHERE path IS NOT NULL",
    "q_label_cover": r"WITH h AS (SELECT DISTINCT doc_id, regexp_extract(h, '^(\d+(?:\.\d+)*) ', 1) AS label FROM (SELECT doc_id, unnest(section_path) AS h FROM chunk_snapshots)) SELECT a.doc_id, a.label, count(*) AS covered FROM h a JOIN h b ON a.doc_id = b.doc_id AND (a.label = b.label OR starts_with(b.label, a.label || '.')) WHERE a.label <> '' GROUP BY 1, 2",
    "q_title_kinds": r"WITH t AS (SELECT title, lower(trim(title || CASE WHEN coalesce(content, '') = '' THEN ' (Part 2)' WHEN coalesce(snippet, '') = '' THEN ' (Stitched)' ELSE '' END)) AS t FROM crawled_items WHERE title IS NOT NULL) SELECT CASE WHEN ends_with(t, '(stitched)') THEN 'stitched' WHEN ends_with(t, '(synthesis)') THEN 'synthesis' WHEN regexp_matches(t, '\(part \d+\)$') THEN 'part' ELSE 'page' END AS kind, count(DISTINCT title) AS titles FROM t GROUP BY 1",
    "q_vector_sample": "SELECT DISTINCT vec_id FROM embedding_cache WHERE embedding IS NOT NULL AND len(embedding) = dim AND vec_id IS NOT NULL ORDER BY vec_id LIMIT 300",
    "q_seed_titles": r"WITH p AS (SELECT split_part(path, '/', 1) AS root, regexp_extract(path, '([^/]+)\.[A-Za-z0-9]+$', 1) AS title FROM documents WHERE path IS NOT NULL) SELECT DISTINCT root, title FROM p WHERE regexp_matches(root, '-(notes|wiki)$') AND NOT regexp_matches(title, '^(claims|draft|_)') AND title <> ''",
    "q_quote_tally": "SELECT coalesce(status, 'unknown') AS status, count(DISTINCT lower(trim(query_text))) AS queries FROM retrieval_events WHERE trim(query_text) <> '' GROUP BY 1",
    "q_page_status": "SELECT coalesce(status, 'unknown') AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM runs GROUP BY 1",
    "q_source_sections": "SELECT doc_id, (i - 1)::INTEGER AS part, length(parts[i])::INTEGER AS chars FROM (SELECT doc_id, string_split(text, chr(10) || '---' || chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10) || '---' || chr(10))) + 1)) AS i FROM documents WHERE contains(text, chr(10) || '---' || chr(10))) WHERE trim(parts[i]) <> ''",
    "q_token_lengths": f"SELECT source, round(avg(len({_TOK})), 4) AS mean_tokens, max(len({_TOK}))::INTEGER AS most_tokens FROM documents GROUP BY 1",
}
