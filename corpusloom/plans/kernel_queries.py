"""Queries whose operators SQL can't express; they are tested against invariants and by hand."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import extract as X
from corpusloom.functions import markdown as M
from corpusloom.functions import structure as S
from corpusloom.operators import kernels as K
from corpusloom.sources.tables import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text"))


def q_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Markdown blocks of every document."""
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, b.kind, b.start, b.end, b.level, b.atomic) for b in M.blocks(t)], "doc_id bigint, kind string, start bigint, end bigint, level int, atomic boolean")


def q_chunks_fixed(spark: SparkSession, d: str) -> DataFrame:
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, k, a, b) for k, (a, b) in enumerate(M.fixed_spans(t, 3000, 200))], "doc_id bigint, chunk_index int, start bigint, end bigint")


def q_chunks_struct(spark: SparkSession, d: str) -> DataFrame:
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, k, a, b, w) for k, (a, b, w) in enumerate(M.structure_spans(t, 1500, 3000))], "doc_id bigint, chunk_index int, start bigint, end bigint, boundary string")


def q_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    def meta(i: int, t: str) -> list[tuple]:
        m, body = M.frontmatter(t)
        return [(i, str(m["title"]) if m.get("title") is not None else None, ",".join(map(str, m.get("tags") or [])), len(body))] if m else []

    return K.flat_map(_docs(spark, d), ["doc_id", "text"], meta, "doc_id bigint, title string, tags string, body_chars bigint")


def q_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of the documents and whether they are well formed."""

    def rows(i: int, t: str) -> list[tuple]:
        return [(i, b.start, len(M.split_row(t[b.start : b.end].split("\n")[0])), M.table_valid(t[b.start : b.end])) for b in M.blocks(t) if b.kind == "table"]

    return K.flat_map(_docs(spark, d), ["doc_id", "text"], rows, "doc_id bigint, start bigint, width int, valid boolean")


def q_markdown_quality(spark: SparkSession, d: str) -> DataFrame:
    """Repairs the cleanup passes would make."""
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, n, c) for n, c in M.clean(t)[1]], "doc_id bigint, repair string, n int")


def q_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, len(t) - len(M.strip_book_boilerplate(t)))], "doc_id bigint, stripped bigint")


def q_pages_text(spark: SparkSession, d: str) -> DataFrame:
    """Readable text of the pages with left-over markup."""
    p = table(spark, d, "crawled_items").filter("content LIKE '%<%>%'").select("item_id", "content").distinct()
    return K.flat_map(spread(p), ["item_id", "content"], lambda i, t: [(i, X.readable(t))], "item_id bigint, text string")


def q_page_links(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "crawled_items").filter("content LIKE '%<a %'").select("item_id", "url", "content").distinct()
    return K.flat_map(spread(p), ["item_id", "url", "content"], lambda i, u, t: [(i, a, b) for a, b in X.links(t, u or "")], "item_id bigint, link string, label string")


def q_json_extract(spark: SparkSession, d: str) -> DataFrame:
    """JSON of the answers, salvaged where it is cut."""
    c = table(spark, d, "llm_calls").filter("response_text LIKE '%[%' OR response_text LIKE '%{%'").select("trace_id", "response_text").distinct()

    def parsed(i: str, t: str) -> list[tuple]:
        v = X.lenient_json(t)
        return [] if v is None else [(i, "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "scalar", len(v) if isinstance(v, list | dict) else 1, json.dumps(v, sort_keys=True, ensure_ascii=False))]

    return K.flat_map(spread(c), ["trace_id", "response_text"], parsed, "trace_id string, kind string, size int, value string")


def q_decay_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each user's purchases replayed for nine pairs of parameters."""
    return K.decay_grid(table(spark, d, "events").filter("event_type = 'purchase'"), "user_id", "ts", [14.0, 21.0, 28.0], [1.5, 1.8, 2.2])


def q_heading_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the documents, from each heading to the next of its level or above."""
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, a, b, level, h) for a, b, level, h in S.heading_spans(t)], "doc_id bigint, start bigint, end bigint, level int, heading string")


def q_promoted(spark: SparkSession, d: str) -> DataFrame:
    """Headings that plain texts would get, and numbered-line tables that would become text."""
    return K.flat_map(_docs(spark, d), ["doc_id", "text"], lambda i, t: [(i, S.promote_headings(t)[1], S.flatten_numbered_tables(t)[1])], "doc_id bigint, headings int, tables int")


def q_identifier_snap(spark: SparkSession, d: str) -> DataFrame:
    """Profile names of the documents snapped to the known ones (a fixed table of four)."""
    known = sorted(r.profile for r in table(spark, d, "split_profiles").select("profile").collect() if r.profile)
    names = table(spark, d, "documents").filter("profile IS NOT NULL").select("profile").distinct()
    return K.flat_map(names, ["profile"], lambda t: [(t, X.snap_identifier(t, known))], "profile string, known string")


QUERIES = {n: f for n, f in globals().items() if n.startswith("q_")}
