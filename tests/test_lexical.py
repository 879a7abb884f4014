"""Lexical queries on small odd tables: against their SQL, and what leaves the blocks of documents."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval
from corpusloom.plans import core_queries, core_sql

WORDS = ["the", "ledger", "audit", "notes", "quiet", "index", "旁", "注", "İstanbul", "model"]


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    """300 documents with equal scores, two rows of one id, rows without id or text, and 20 titles (two of them equal)."""
    d = str(tmp_path_factory.mktemp("lexical"))
    day = lambda i: datetime(2025, 1, 1) + timedelta(days=i % 40)
    docs = [(i, " ".join(["the", *(WORDS[(i * j) % 10] for j in range(1, 3 + i % 5))]), f"s{i % 3}", day(i) if i % 7 else None) for i in range(300)]
    docs += [(5, "the audit of the quiet ledger notes", "s2", day(5)), (None, "quiet index", "s1", day(1)), (None, "audit index", "s1", day(1)), (900, None, "s1", day(2)), (901, "", "s1", day(2))]
    docs[5] = (5, "quiet model of the audit index notes", "s2", day(5))
    spark.createDataFrame(docs, "doc_id long, text string, source string, updated timestamp").repartition(3).write.parquet(f"{d}/documents.parquet")
    titles = [(100 * i, " ".join(["the", WORDS[i % 10], WORDS[(3 * i) % 10], WORDS[i % 10]])) for i in range(17)]
    titles += [(5000, "Istanbul"), (5100, "whale"), (5200, None), (5300, "the notes"), (5300, "the audit"), (5301, "not asked")]
    spark.createDataFrame(titles, "item_id long, title string").write.parquet(f"{d}/crawled_items.parquet")
    return d


def both(spark, where, name):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in ("documents", "crawled_items"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    df = core_queries.QUERIES[name](spark, where)
    return [sorted(map(tuple, x), key=str) for x in (df.collect(), con.sql(core_sql.SQL[name]).select(*df.columns).fetchall())]


@pytest.mark.parametrize("name", ["q_bm25", "q_doc_cap", "q_hybrid"])
def test_odd_rows_as_sql(spark, where, name):
    got, expected = both(spark, where, name)
    assert got == expected and len(got) > 100


@pytest.mark.parametrize(("name", "k"), [("q_bm25", 10), ("q_doc_cap", 30), ("q_hybrid", 30)])
def test_only_the_best_leave_their_block(spark, where, monkeypatch, name, k):
    kept = []
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *_: kept.append(scored) or scored.withColumn("rank", F.lit(1)))
    core_queries.QUERIES[name](spark, where)
    assert 0 < kept[0].count() <= 20 * k * kept[0].rdd.getNumPartitions()


def test_blocks_of_documents_and_queries(spark, where, monkeypatch):
    docs, titles = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "crawled_items"))
    queries = titles.selectExpr("item_id AS query_id", "title AS query")
    run = lambda: sorted(map(tuple, retrieval.bm25_top(queries, docs, "doc_id", "text", 7).collect()), key=str)
    whole = run()
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 3)
    assert run() == whole
    small = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        scorer = retrieval._lexical_scorer

        def blocks(*a):
            run = scorer(*a)

            def each(batches):
                whole, retrieval.DOC_BLOCK = retrieval.DOC_BLOCK, 20  # in the worker
                try:
                    yield from run(batches)
                finally:
                    retrieval.DOC_BLOCK = whole

            return each

        monkeypatch.setattr(retrieval, "_lexical_scorer", blocks)
        assert run() == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", small)
