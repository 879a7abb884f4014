"""Folders of Markdown notes, claim pages, feeds and target lists as DataFrames."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import extract, markdown
from corpusloom.functions.text import normalize_tags
from corpusloom.operators.kernels import flat_map

_HASHTAG = re.compile(r"(?:^|\s)#([^\s#.,;:!?()\[\]]+)")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, section, title, tags, date, body, digest) of every .md file below a folder; names that begin with . or _ are skipped.

    Broken frontmatter gives an empty meta; hashtags of the body count as tags; the date is the first of date_created,
    created, date and the file's own time.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"))
    root = "/" + folder.split("://", 1)[-1].strip("/") + "/"
    inner = F.regexp_replace("path", "^.*?" + re.escape(root), "")
    files = files.withColumn("inner", inner).filter(~F.col("inner").rlike("(^|/)[._]"))

    def parse(path: str, inner: str, text: str) -> list[tuple]:
        meta, body = markdown.frontmatter(text)
        tags = meta.get("tags") or []
        tags = [str(t) for t in (tags if isinstance(tags, list) else [tags])] + _HASHTAG.findall(body)
        date = next((str(meta[k]) for k in ("date_created", "created", "date") if meta.get(k)), None)
        title = str(meta.get("title") or inner.rsplit("/", 1)[-1][:-3])
        return [(path, inner.split("/")[0] if "/" in inner else "", title, "\x1f".join(tags), date, body)]

    rows = flat_map(files, ["path", "inner", "value"], parse, "path string, section string, title string, tags string, date string, body string")
    out = rows.join(files.select("path", "mtime"), "path")
    tags = normalize_tags(F.split("tags", "\x1f"))
    return out.select("path", "section", "title", tags.alias("tags"), F.coalesce(F.try_to_timestamp("date"), "mtime").alias("date"), "body", F.sha2("body", 256).alias("digest"))


def parse_claim(text: str) -> dict | None:
    """A claim page (frontmatter with claim_id and claim) as a dict; None for any other."""
    meta, body = markdown.frontmatter(text)
    if not meta.get("claim_id") or not meta.get("claim"):
        return None
    evidence = [e for e in meta.get("evidence") or [] if isinstance(e, dict) and e.get("insight")]
    return {"claim_id": str(meta["claim_id"]), "claim": str(meta["claim"]), "status": str(meta.get("status") or "active"), "confidence": 0.5 if meta.get("confidence") is None else float(meta["confidence"]), "S": float(meta.get("S") or 0.0), "evidence": evidence, **{k: [str(x) for x in meta[k]] for k in ("contradictions", "related", "variants") if isinstance(meta.get(k), list)}, "body": body}


def render_claim(page: dict) -> str:
    """The page as Markdown; parsing it again gives the same dict."""
    meta = {k: v for k, v in page.items() if k != "body"}
    return f"---\n{yaml.safe_dump(meta, allow_unicode=True, sort_keys=False)}---\n{page.get('body', '')}"


def read_claims(spark: SparkSession, folder: str) -> DataFrame:
    """(path, claim_id, claim, status, confidence, s, evidence) of the valid claim pages; invalid ones are left out."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("path"))

    def parse(path: str, text: str) -> list[tuple]:
        c = None if path.rsplit("/", 1)[-1].startswith("_") else parse_claim(text)
        return [(path, c["claim_id"], c["claim"], c["status"], c["confidence"], c["S"], len(c["evidence"]))] if c else []

    return flat_map(files, ["path", "value"], parse, "path string, claim_id string, claim string, status string, confidence double, s double, evidence int")


def feed_items(pages: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, title, url, key, snippet) of saved RSS or Atom feeds."""
    items = lambda i, x: [(str(i), e["title"], e["url"], e["key"], e["snippet"]) for e in extract.feed_items(x or "")]
    return flat_map(pages, [id_col, xml_col], items, "id string, title string, url string, key string, snippet string")


def targets(text: str) -> list[dict]:
    """Rows of the first table whose header has a ``url`` column."""
    for b in markdown.blocks(text):
        if b.kind == "table":
            rows = [markdown.split_row(r) for r in text[b.start : b.end].strip().splitlines()]
            head = [h.lower() for h in rows[0]]
            if "url" in head and len(rows) > 2:
                return [dict(zip(head, r)) for r in rows[2:] if len(r) == len(head) and r[head.index("url")]]
    return []
