"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, chunking, neighbours, packing, pairs, sentences, tokenizer, truncation
from corpusloom.sources.tables import spread, table

CONTAINER_TOKENS = 2048


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines of content and snippet that aren't main body."""
    return boilerplate.furniture_lines(spread(table(spark, d, "crawled_items")))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each item."""
    return boilerplate.main_bodies(spread(table(spark, d, "crawled_items")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The calls whose response is no proper answer, with their defect."""
    return pairs.defects(spread(table(spark, d, "llm_calls"))).filter("defect IS NOT NULL").select("trace_id", "defect")


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_calls(spread(table(spark, d, "llm_calls")), pairs.holds_text)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The calls whose response was cut, with their stage."""
    return _cut(spark, d).filter("cut").select("trace_id", "stage")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each stage truncates."""
    cut = F.sum(F.when(F.col("cut"), 1).otherwise(0))
    return _cut(spark, d).groupBy("stage").agg(F.count("*").alias("calls"), cut.alias("cut"), (cut / F.count("*")).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The recorded pieces that break the contract."""
    return chunking.piece_faults(table(spark, d, "chunk_snapshots"), table(spark, d, "documents"), table(spark, d, "split_profiles"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every document over its limit."""
    docs, profiles = table(spark, d, "documents"), table(spark, d, "split_profiles")
    over = docs.join(F.broadcast(profiles.select("profile", "max_chars")), "profile").filter(F.length("text") > F.col("max_chars"))
    return chunking.split_documents(spread(over.select("doc_id", "text", "profile")), profiles)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of similar vectors of which one is among the 5 most similar of the other."""
    return neighbours.similar_pairs(spread(table(spark, d, "embedding_cache")))


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar vectors of every vector, however similar, with their similarity."""
    return neighbours.neighbours(spread(table(spark, d, "embedding_cache")), least=-1.0)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of each document in byte_bpe_50k."""
    return tokenizer.encode_texts(_texts(spark, d))


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids don't decode to their text: none."""
    docs = _texts(spark, d)
    back = tokenizer.decode_ids(tokenizer.encode_texts(docs)).select("doc_id", F.xxhash64("text").alias("h"))
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).exceptAll(back).select("doc_id")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).filter("text IS NOT NULL AND text != ''")
    return packing.pack(tokenizer.token_counts(docs), CONTAINER_TOKENS)


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each document's pieces and the containers of 2,048 tokens that hold them."""
    start = F.col("piece").cast("bigint") * CONTAINER_TOKENS
    return _packed(spark, d).select(
        F.col("container").alias("container_id"), F.col("item_id").alias("doc_id"), "piece", start.alias("token_start"), (start + F.col("size")).alias("token_end"), F.col("size").alias("tokens")
    )


def p9_certificates(spark: SparkSession, d: str) -> DataFrame:
    """What certifies the container count of each packing."""
    return packing.certificates(_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.sentence_units(_texts(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_bodies": p1_bodies,
    "p2_found": p2_found,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_containers": p9_containers,
    "p9_certificates": p9_certificates,
    "p10_found": p10_found,
}
SQL: dict[str, str] = {}
