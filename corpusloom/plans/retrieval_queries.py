"""Queries over documents, pages and vectors: retrieval, fusion, diversity, with their SQL.

Search queries are the rows whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval as R
from corpusloom.operators import stats
from corpusloom.session import Stages
from corpusloom.sources.tables import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _title_queries(spark: SparkSession, d: str) -> DataFrame:
    """Page titles as search texts."""
    pages = table(spark, d, "crawled_items").filter("item_id % 100 = 0 AND title IS NOT NULL")
    return pages.groupBy(F.col("item_id").alias("query_id")).agg(F.min("title").alias("query"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return spread(_docs(spark, d).select("doc_id", "text")).select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("distinct_tokens"))


def _ranked_bm25(spark: SparkSession, d: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    return R.bm25_top(_title_queries(spark, d) if queries is None else queries, _docs(spark, d), "doc_id", "text", k)


def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ranked_bm25(spark, d, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def _capped(spark: SparkSession, d: str, queries: DataFrame | None = None) -> DataFrame:
    ranked = _ranked_bm25(spark, d, 30, queries).join(_docs(spark, d).select(F.col("doc_id").alias("doc"), "source"), "doc")
    return R.cap_per_key(ranked, "source", 2).select("query_id", F.col("doc").alias("doc_id"), "source", "rank")


def q_doc_cap(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of every page title over the documents, at most two documents per source: the first ten of each query."""
    titles = table(spark, d, "crawled_items").filter("title IS NOT NULL").groupBy(F.col("item_id").alias("query_id")).agg(F.min("title").alias("query"))
    return R.top_k(_capped(spark, d, titles).withColumnRenamed("rank", "bm25_rank"), 10, "query_id", F.col("bm25_rank"))


def _top(spark: SparkSession, d: str, k: int, metric: str) -> DataFrame:
    return R.vector_search(_vector_queries(spark, d), table(spark, d, "embeddings"), k, metric)


def q_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 10, "l2").select("query_id", "vec_id", F.col("value").alias("distance"), "rank")


def q_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 10, "cosine").select("query_id", "vec_id", F.col("value").alias("similarity"), "rank")


def q_knn_join(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar others at or above the link floor."""
    near = R.vector_search(_vector_queries(spark, d), table(spark, d, "embeddings"), 5, "cosine", where=lambda q, x: q != x)
    return near.filter("value >= 0.3").select("query_id", "vec_id", F.col("value").alias("similarity"))


def q_novelty(spark: SparkSession, d: str) -> DataFrame:
    """1 - greatest similarity to any earlier vector; 1, and -1 as the id, without a positive one."""
    near = R.vector_search(_vector_queries(spark, d), table(spark, d, "embeddings"), 1, "cosine", where=lambda q, x: x < q)
    best = near.filter("value > 0").select("query_id", F.col("vec_id").alias("most_similar"), "value")
    return _vector_queries(spark, d).select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("most_similar", F.lit(-1).cast("bigint")).alias("most_similar"), F.round(F.greatest(F.lit(0.0), 1 - F.coalesce("value", F.lit(0.0))), 6).alias("novelty"))


def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    fused = R.rrf([_top(spark, d, 20, "cosine"), _top(spark, d, 20, "l2")], "vec_id").withColumn("score", F.round("score", 8))
    return R.top_k(fused, 10, "query_id", F.col("score").desc(), F.col("vec_id")).select("query_id", "vec_id", "score", "rank")


def q_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Lexical rank fused with recency rank of the same candidates."""
    lexical = Stages(spark, "hybrid").cut(_ranked_bm25(spark, d, 30))  # both rankings read it
    dated = lexical.join(_docs(spark, d).select(F.col("doc_id").alias("doc"), "updated"), "doc")
    recent = dated.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("updated").desc_nulls_last(), F.col("doc"))))
    fused = R.rrf([lexical, recent], "doc").withColumn("score", F.round("score", 8))
    return R.top_k(fused, 10, "query_id", F.col("score").desc(), F.col("doc").asc_nulls_last()).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def q_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Half cosine, half the second score over its maximum (here the closeness 1 / (1 + distance))."""
    a = _top(spark, d, 20, "cosine").select("query_id", "vec_id", F.col("value").alias("cos"))
    b = _top(spark, d, 20, "l2").select("query_id", "vec_id", (1 / (1 + F.col("value"))).alias("near"))
    most = b.groupBy("query_id").agg(F.max("near").alias("most"))
    both = a.join(b, ["query_id", "vec_id"]).join(most, "query_id")
    return both.select("query_id", "vec_id", F.round(0.5 * F.col("cos") + 0.5 * F.col("near") / F.col("most"), 5).alias("score"))


def q_mmr(spark: SparkSession, d: str) -> DataFrame:
    pool = _top(spark, d, R.pool_size(5, mmr=True), "cosine").join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id")
    return R.mmr(pool, 5)


def q_facet_deref(spark: SparkSession, d: str) -> DataFrame:
    """Documents' headings as facets, led to the first recorded chunk of their document."""
    chunks = table(spark, d, "chunk_snapshots").filter("chunk_index IS NOT NULL").distinct()
    facets = chunks.select("doc_id", F.explode("section_path").alias("facet")).distinct()
    found, _ = R.facet_parents(chunks, facets)
    return found.groupBy("doc_id", "chunk_index", "char_start").agg(F.count("*").alias("facets"))


def q_bridging(spark: SparkSession, d: str) -> DataFrame:
    """1 - least cosine among the four vectors of a set."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("set_id"), "vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.set_id") == F.col("b.set_id")) & (F.col("a.vec_id") < F.col("b.vec_id")))
    return pairs.groupBy(F.col("a.set_id").alias("set_id")).agg(F.round(F.greatest(F.lit(0.0), 1 - F.min(V.cosine(F.col("a.embedding"), F.col("b.embedding")))), 6).alias("bridging"))


def q_eff_dim(spark: SparkSession, d: str) -> DataFrame:
    return stats.effective_dimension(table(spark, d, "embeddings"))


def q_where(spark: SparkSession, d: str) -> DataFrame:
    """Conjunctive filter: every section level by position, and a custom condition."""
    c = table(spark, d, "chunk_snapshots").distinct()
    levels = F.transform("section_path", lambda x: F.lower(F.trim(x)))
    return c.filter(F.get(levels, F.lit(0)).isNotNull() & F.get(levels, F.lit(1)).isNotNull() & F.get(levels, F.lit(1)).contains("of") & (F.col("boundary_type") == "paragraph")).select("doc_id", "chunk_index", F.get(levels, F.lit(1)).alias("section_l2"))


def q_embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose cached vector can't serve and would be computed again."""
    e = table(spark, d, "embedding_cache")
    good = F.col("embedding").isNotNull() & (F.size("embedding") == F.col("dim")) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))) & F.exists("embedding", lambda x: x != 0)
    return e.groupBy("cache_key").agg(F.max(F.coalesce(good, F.lit(False))).alias("usable")).filter("NOT usable").select("cache_key")


def _retrieved(spark: SparkSession, d: str, use_facets: bool = True) -> DataFrame:
    """Documents with a vector of their id as chunks, texts under 200 characters as facets; queries are the file names of documents."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = _docs(spark, d).filter("text IS NOT NULL AND n_chars > 0").join(e, "doc_id")
    role = F.when(F.col("n_chars") < 200, "facet").otherwise("chunk")
    chunks = docs.select(F.col("doc_id").alias("id"), "text", "embedding", role.alias("role"), "profile", F.col("source").alias("key"))
    asked = docs.filter("doc_id % 100 = 0 AND path IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.regexp_replace(F.lower("path"), "[^a-z0-9]+", " ").alias("query"), "embedding")
    tokens = lambda c: F.array_distinct(T.tokens(c))
    share = lambda q, t: F.size(F.array_intersect(tokens(q), tokens(t))) / F.greatest(F.lit(1), F.size(tokens(q)))
    index = R.LexicalIndex.build(chunks, "id", "text")
    return R.retrieve(asked, chunks, index, 10, use_facets=use_facets, where=F.col("profile").isNotNull(), rerank=share)


def q_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline: vectors, BM25, fusion, fetch of missing ids, rerank, cap per source."""
    return _retrieved(spark, d)


def q_bench(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document is found by its file name and vector, with the facets and without them, and the lift by facets."""
    golden = _retrieved_golden(spark, d)
    on, off = (R.bench(_retrieved(spark, d, f), golden) for f in (True, False))
    return on.join(F.broadcast(off.select(F.col("passed").alias("passed_off")))).withColumn("facet_lift", F.col("passed") - F.col("passed_off"))


def _retrieved_golden(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    docs = _docs(spark, d).filter("text IS NOT NULL AND n_chars > 0 AND doc_id % 100 = 0 AND path IS NOT NULL").join(e, "doc_id")
    return docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("id"))


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}

_TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"
_BM25 = rf"""
queries AS (SELECT item_id AS query_id, min(title) AS query FROM crawled_items WHERE item_id % 100 = 0 AND title IS NOT NULL GROUP BY 1),
toks AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
raw AS (SELECT term, n, avgdl, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term, n, avgdl),
idf AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM queries) GROUP BY 1, 2),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS exact
  FROM asked JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE exact > 0)
"""
_PAIRS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id % 100 = 0),
x AS (SELECT vec_id, embedding::DOUBLE[] AS xe FROM embeddings),
cosv AS (SELECT query_id, vec_id, round(list_cosine_similarity(qe, xe), 6) AS value FROM q, x),
l2v AS (SELECT query_id, vec_id, round(list_distance(qe, xe) ** 2, 6) AS value FROM q, x),
cosr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id) AS rank FROM cosv),
l2r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value, vec_id) AS rank FROM l2v)
"""
_RETRIEVE = (
    _BM25.replace("queries AS (SELECT item_id AS query_id, min(title) AS query FROM crawled_items WHERE item_id % 100 = 0 AND title IS NOT NULL GROUP BY 1),", """
chunks AS (SELECT doc_id, text, embedding::DOUBLE[] AS v, n_chars < 200 AS facet, profile, source FROM documents JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL AND n_chars > 0),
queries AS (SELECT doc_id AS query_id, regexp_replace(lower(path), '[^a-z0-9]+', ' ', 'g') AS query, embedding::DOUBLE[] AS qv FROM documents JOIN embeddings ON vec_id = doc_id WHERE text IS NOT NULL AND n_chars > 0 AND doc_id % 100 = 0 AND path IS NOT NULL),""").replace("FROM documents)", "FROM chunks)")
    + rf""",
runs_of AS (SELECT unnest([true, false]) AS facets),
ok AS (SELECT facets, c.* FROM chunks c, runs_of WHERE profile IS NOT NULL AND (facets OR NOT facet)),
vec AS (SELECT * FROM (SELECT facets, query_id, doc_id, row_number() OVER (PARTITION BY facets, query_id ORDER BY round(list_cosine_similarity(qv, v), 6) DESC, doc_id) AS vector_rank FROM queries, ok) WHERE vector_rank <= 50),
lex AS (SELECT facets, query_id, doc_id, rank AS bm25_rank FROM ranked JOIN ok USING (doc_id) WHERE rank <= 50),
pool AS (SELECT facets, query_id, doc_id, vector_rank, bm25_rank, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 8) AS score FROM vec FULL JOIN lex USING (facets, query_id, doc_id)),
reranked AS (SELECT p.*, c.source, round(len(list_intersect(list_distinct({_TOK.format('query')}), list_distinct({_TOK.format('text')}))) / greatest(1, len(list_distinct({_TOK.format('query')})))::DOUBLE, 6) AS rerank_score FROM pool p JOIN queries USING (query_id) JOIN chunks c USING (doc_id)),
capped AS (SELECT * FROM reranked QUALIFY row_number() OVER (PARTITION BY facets, query_id, source ORDER BY rerank_score DESC, score DESC, doc_id) <= 2),
final AS (SELECT *, row_number() OVER (PARTITION BY facets, query_id ORDER BY rerank_score DESC, score DESC, doc_id) AS rank FROM capped QUALIFY rank <= 10)
"""
)
SQL = {
    "q_retrieve": f"WITH {_RETRIEVE} SELECT query_id, doc_id AS id, vector_rank::INTEGER AS vector_rank, bm25_rank::INTEGER AS bm25_rank, score, rerank_score, rank::INTEGER AS rank FROM final WHERE facets",
    "q_bench": f"WITH {_RETRIEVE}, p AS (SELECT count(*) AS total, count(*) FILTER (query_id IN (SELECT query_id FROM final WHERE facets AND doc_id = query_id)) AS passed, count(*) FILTER (query_id IN (SELECT query_id FROM final WHERE NOT facets AND doc_id = query_id)) AS passed_off FROM queries) SELECT total, passed, round(passed / total, 6) AS pass_rate, CASE WHEN passed / total < 0.8 THEN 'failed' ELSE 'passed' END AS status, passed_off, passed - passed_off AS facet_lift FROM p",
    "q_tokens": f"SELECT doc_id, len(t)::INTEGER AS tokens, len(list_distinct(t))::INTEGER AS distinct_tokens FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
    "q_bm25": f"WITH {_BM25} SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM ranked WHERE rank <= 10",
    "q_doc_cap": f"WITH {_BM25} SELECT query_id, doc_id, source, rank::INTEGER AS rank FROM (SELECT r.query_id, r.doc_id, d.source, r.rank, row_number() OVER (PARTITION BY r.query_id, d.source ORDER BY r.rank) AS n FROM ranked r JOIN documents d USING (doc_id) WHERE r.rank <= 30) WHERE n <= 2",
    "q_vector_topk": f"WITH {_PAIRS} SELECT query_id, vec_id, value AS distance, rank::INTEGER AS rank FROM l2r WHERE rank <= 10",
    "q_cosine_topk": f"WITH {_PAIRS} SELECT query_id, vec_id, value AS similarity, rank::INTEGER AS rank FROM cosr WHERE rank <= 10",
    "q_knn_join": f"WITH {_PAIRS} SELECT query_id, vec_id, value AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id) AS n FROM cosv WHERE query_id <> vec_id) WHERE n <= 5 AND value >= 0.3",
    "q_novelty": f"WITH {_PAIRS}, best AS (SELECT query_id, vec_id, value, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, vec_id) AS n FROM cosv WHERE vec_id < query_id) SELECT q.query_id, CASE WHEN b.value > 0 THEN b.vec_id ELSE -1 END AS most_similar, round(greatest(0.0::DOUBLE, 1 - CASE WHEN b.value > 0 THEN b.value ELSE 0.0::DOUBLE END), 6) AS novelty FROM q LEFT JOIN best b ON b.query_id = q.query_id AND b.n = 1",
    "q_rrf": f"WITH {_PAIRS}, fused AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, vec_id, rank FROM cosr WHERE rank <= 20 UNION ALL SELECT query_id, vec_id, rank FROM l2r WHERE rank <= 20) GROUP BY 1, 2) SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM fused) WHERE rank <= 10",
    "q_hybrid": f"WITH {_BM25}, lexical AS (SELECT query_id, doc_id, rank FROM ranked WHERE rank <= 30), recent AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY updated DESC NULLS LAST, doc_id) AS rank FROM lexical JOIN documents USING (doc_id)), fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT * FROM lexical UNION ALL SELECT * FROM recent) GROUP BY 1, 2) SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fused) WHERE rank <= 10",
    "q_weighted_fusion": f"WITH {_PAIRS}, b AS (SELECT query_id, vec_id, 1 / (1 + value) AS near FROM l2r WHERE rank <= 20), m AS (SELECT query_id, max(near) AS most FROM b GROUP BY 1) SELECT query_id, vec_id, round(0.5::DOUBLE * a.value + 0.5::DOUBLE * near / most, 5) AS score FROM cosr a JOIN b USING (query_id, vec_id) JOIN m USING (query_id) WHERE a.rank <= 20",
    "q_facet_deref": "WITH c AS (SELECT DISTINCT * FROM chunk_snapshots WHERE chunk_index IS NOT NULL), f AS (SELECT DISTINCT doc_id, unnest(section_path) AS facet FROM c), p AS (SELECT doc_id, arg_min(chunk_index, char_start) AS chunk_index, min(char_start) AS char_start FROM c GROUP BY 1) SELECT doc_id, chunk_index, char_start, count(*) AS facets FROM f JOIN p USING (doc_id) GROUP BY ALL",
    "q_bridging": "WITH e AS (SELECT vec_id // 4 AS set_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.set_id, round(greatest(0.0::DOUBLE, 1 - min(list_cosine_similarity(a.v, b.v))), 6) AS bridging FROM e a JOIN e b ON a.set_id = b.set_id AND a.vec_id < b.vec_id GROUP BY 1",
    "q_eff_dim": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM f), m AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM c a JOIN c b USING (vec_id) GROUP BY 1, 2) SELECT (SELECT count(*) FROM e) AS n, round((sum(CASE WHEN i = j THEN c END)) ** 2 / sum(c * c), 3) AS eff_dim FROM m",
    "q_where": "SELECT DISTINCT doc_id, chunk_index, lower(trim(section_path[2])) AS section_l2 FROM (SELECT DISTINCT * FROM chunk_snapshots) WHERE section_path[1] IS NOT NULL AND contains(lower(trim(section_path[2])), 'of') AND boundary_type = 'paragraph'",
    "q_embedding_cache": "SELECT cache_key FROM embedding_cache GROUP BY 1 HAVING NOT max(coalesce(embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)::INTEGER)::BOOLEAN",
}
