"""Splitting oversized items at natural boundaries (problem 6).

Method: content-defined chunking.  A rolling hash over the last characters marks landmarks that depend on the text
around them only; from a piece's minimum size on, the first landmark before its maximum size is taken and snaps to the
nearest natural boundary (a heading of level 1 to 4, the end of an empty line, the end of a sentence) within minimum
and maximum.  Where there is no landmark the last natural boundary is taken, where there is no boundary the landmark or
the maximum.  As landmarks and boundaries move with the text, an edit alters only pieces near it.

A piece is (char_start, char_end); pieces tile the text, none exceeds the limit, and the overlap is recorded as the
number of characters of the piece before that a reader may put in front.

``piece_faults`` holds recorded pieces against the same contract, by the boundary map the splitter cuts at.

Defined results: texts within their limit give one piece ending in ``doc_end``; null and empty texts give none; a
profile that is null or unknown has no limit, so its texts aren't split.  Recorded pieces of a document without text
are judged against an empty text.  Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.sentences import scan

#: Characters the rolling hash sees, and the least size of a piece as a share of its limit.
HASH_WINDOW = 24
LEAST = 0.5
#: Fixed pseudo-random weights of the hash, by code point modulo 4096.
_GEAR = np.random.default_rng(20250101).integers(0, 2**63, 4096, dtype=np.int64).astype(np.uint64)
#: Which boundary wins where several lie equally near.
_RANK = {"h1": 0, "h2": 1, "h3": 2, "h4": 3, "paragraph": 4, "sentence": 5}


@dataclass
class BoundaryMap:
    """What lies where in one text."""

    heads: list[tuple[int, int, str]]
    empties: frozenset
    sentence_ends: frozenset
    length: int

    @classmethod
    def of(cls, text: str) -> BoundaryMap:
        units, heads, empties = scan(text)
        return cls(heads, frozenset(empties), frozenset(e for _, e in units), len(text))

    def cuts(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Positions where a piece may end, with the kind that names it."""
        kinds: dict[int, str] = {}
        for e in self.sentence_ends:
            while e < self.length and text[e].isspace() and text[e] != "\n":
                e += 1
            kinds[e] = "sentence"
        kinds.update(dict.fromkeys(self.empties, "paragraph"))
        kinds.update({at: f"h{level}" for at, level, _ in self.heads if level <= 4})
        kinds.pop(0, None)
        kinds.pop(self.length, None)
        at = sorted(kinds)
        return np.array(at, dtype=np.int64), [kinds[x] for x in at]

    def path(self, start: int) -> list[str]:
        """The headings in force at a position, outermost first."""
        stack: list[tuple[int, str]] = []
        for at, level, text in self.heads:
            if at > start:
                break
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
        return [t for _, t in stack]

    def is_boundary(self, text: str, end: int, kind: str | None) -> bool:
        if kind == "forced":
            return True
        if kind == "doc_end":
            return end == self.length
        if kind == "paragraph":
            return end in self.empties
        if kind == "sentence":
            return len(text[:end].rstrip()) in self.sentence_ends
        return kind in ("h1", "h2", "h3", "h4") and any(at == end and f"h{level}" == kind for at, level, _ in self.heads)


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions after which the rolling hash is zero in as many bits as give the spacing on average."""
    g = _GEAR[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) & 4095]
    h = np.zeros(len(g), dtype=np.uint64)
    for k in range(min(HASH_WINDOW, len(g))):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    bits = max(1, int(np.log2(max(2, spacing))))
    return np.flatnonzero(h >> np.uint64(64 - bits) == 0) + 1


def split(text: str, max_chars: int, overlap: int) -> list[tuple[int, int, list[str], str, int]]:
    """(char_start, char_end, section_path, boundary_type, overlap_chars) of each piece."""
    n = len(text)
    where = BoundaryMap.of(text)
    at, kinds = where.cuts(text) if n > max_chars else (np.array([], dtype=np.int64), [])
    least = max(1, int(max_chars * LEAST))
    marks = landmarks(text, max(2, max_chars // 8)) if n > max_chars else at
    out, start, before = [], 0, 0
    while start < n:
        if n - start <= max_chars:
            end, kind = n, "doc_end"
        else:
            lo, hi = start + least, start + max_chars
            i, j = np.searchsorted(at, lo), np.searchsorted(at, hi, side="right")
            m = np.searchsorted(marks, lo)
            mark = int(marks[m]) if m < len(marks) and marks[m] <= hi else hi
            if i < j:
                near = min(range(i, j), key=lambda x: (abs(int(at[x]) - mark), _RANK[kinds[x]]))
                end, kind = int(at[near]), kinds[near]
            else:
                end, kind = mark, "forced"
        out.append((start, end, where.path(start), kind, min(overlap, before) if start else 0))
        before, start = end - start, end
    return out


def split_documents(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pieces of every document, as chunk_snapshots has them.  ``profiles`` is a fixed small table of limits, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not text:
                    continue
                for k, (a, b, path, kind, over) in enumerate(split(text, limit or len(text), overlap or 0)):
                    for col, v in zip(cols, (doc, k, a, b, b - a, path, kind, over)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    wide = docs.select("doc_id", "text", "profile").join(F.broadcast(_limits(profiles)), "profile", "left")
    return wide.select(F.col("doc_id").cast("bigint"), "text", "max_chars", "overlap_chars").mapInArrow(run, _SCHEMA)


_NAMES = ["doc_id", "chunk_index", "char_start", "char_end", "size", "section_path", "boundary_type", "overlap_chars"]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64()]
_SCHEMA = "doc_id bigint, chunk_index int, char_start bigint, char_end bigint, size bigint, section_path array<string>, boundary_type string, overlap_chars bigint"


def _limits(profiles: DataFrame) -> DataFrame:
    return profiles.filter("profile IS NOT NULL").groupBy("profile").agg(F.max("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars"))


def faults(text: str, limit: int | None, overlap: int | None, pieces: list[dict]) -> list[int]:
    """The indexes of the recorded pieces that break the contract in any point."""
    where = BoundaryMap.of(text)
    out, before = set(), None
    pieces = sorted(pieces, key=lambda p: (p["chunk_index"], p["char_start"] or 0, p["char_end"] or 0))
    for k, p in enumerate(pieces):
        a, b = p["char_start"], p["char_end"]
        if a is None or b is None or p["size"] is None or p["size"] != b - a:
            bad = True
        else:
            bad = (
                limit is not None and b - a > limit
                or a != (before["char_end"] if before else 0)
                or k == len(pieces) - 1 and b != len(text)
                or overlap is not None and p["overlap_chars"] != (min(overlap, before["size"] or 0) if before else 0)
                or (p["section_path"] or []) != where.path(a)
                or not where.is_boundary(text, b, p["boundary_type"])
            )
        if bad:
            out.add(p["chunk_index"])
        before = p
    return sorted(out)


def piece_faults(pieces: DataFrame, docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, chunk_index) of each recorded piece that breaks the contract.

    The pieces of a document meet its text in one join on doc_id; a document's pieces are bounded by its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, idx = [], []
            for doc, text, limit, overlap, rows in zip(*(batch.column(i).to_pylist() for i in range(5))):
                bad = faults(text or "", limit, overlap, rows)
                ids += [doc] * len(bad)
                idx += bad
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(idx, pa.int32())], names=["doc_id", "chunk_index"])

    row = F.struct("chunk_index", "char_start", "char_end", "size", "section_path", "boundary_type", "overlap_chars")
    grouped = pieces.filter("doc_id IS NOT NULL AND chunk_index IS NOT NULL").groupBy("doc_id").agg(F.collect_set(row).alias("pieces"))
    wide = grouped.join(docs.select("doc_id", "text", "profile"), "doc_id", "left").join(F.broadcast(_limits(profiles)), "profile", "left")
    return wide.select(F.col("doc_id").cast("bigint"), "text", "max_chars", "overlap_chars", "pieces").mapInArrow(run, "doc_id bigint, chunk_index int")
