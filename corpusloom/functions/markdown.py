"""Markdown kernels in plain Python, to be run inside Arrow batches: blocks, splitters, frontmatter, tables, repairs."""

from __future__ import annotations

import re
from dataclasses import dataclass

import yaml

_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_BULLET = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+")
_RULE = re.compile(r"\s*(?:-{3,}|\*{3,}|_{3,})\s*$")


@dataclass(frozen=True)
class Block:
    kind: str
    start: int
    end: int
    level: int = 0
    heading: str = ""
    atomic: bool = False


def blocks(text: str) -> list[Block]:
    """Leaf blocks that cover every character exactly once: frontmatter, fence, math, heading, table, list, quote, html, rule, blank, paragraph.

    A state machine over lines; lines of one kind that follow one another are one block.  Fences and math that are never
    closed run to the end.
    """
    out: list[Block] = []
    at, open_mark, opened, kind_open = 0, "", 0, ""
    lines = text.splitlines(keepends=True)
    if lines and lines[0].strip() == "---":
        for k in range(1, len(lines)):
            if lines[k].strip() in ("---", "..."):
                size = sum(map(len, lines[: k + 1]))
                out.append(Block("frontmatter", 0, size, atomic=True))
                at, lines = size, lines[k + 1 :]
                break

    def add(kind: str, a: int, b: int, level: int = 0, heading: str = "") -> None:
        merge = kind in ("table", "list", "quote", "html", "blank", "paragraph")
        if merge and out and out[-1].kind == kind and out[-1].end == a:
            out[-1] = Block(kind, out[-1].start, b, atomic=kind == "table")
        else:
            out.append(Block(kind, a, b, level, heading, kind in ("fence", "table", "math", "frontmatter")))

    for line in lines:
        end, bare = at + len(line), line.strip()
        if open_mark:
            closing = bare == "$$" or bare.endswith("$$") if open_mark == "$$" else bare.startswith(open_mark) and not bare.strip(open_mark[0])
            if closing:
                add(kind_open, opened, end)
                open_mark = ""
        elif not bare:
            add("blank", at, end)
        elif m := _FENCE.match(line):
            open_mark, opened, kind_open = m.group(1), at, "fence"
        elif bare.startswith("$$") and not (len(bare) > 2 and bare.endswith("$$")):
            open_mark, opened, kind_open = "$$", at, "math"
        elif m := _HEADING.match(line.rstrip("\r\n")):
            add("heading", at, end, len(m.group(1)), m.group(2))
        elif _RULE.match(line):
            add("rule", at, end)
        elif bare.startswith("|"):
            add("table", at, end)
        elif bare.startswith(">"):
            add("quote", at, end)
        elif _BULLET.match(line) or out and out[-1].kind == "list" and out[-1].end == at and line[:1] in " \t":
            add("list", at, end)
        elif bare.startswith("<") and bare.endswith(">"):
            add("html", at, end)
        else:
            add("paragraph", at, end)
        at = end
    if open_mark:
        add(kind_open, opened, at)
    return out


def fixed_spans(text: str, size: int, overlap: int = 0, reach: int = 2000) -> list[tuple[int, int]]:
    """Windows of about ``size``: each end snaps back, within ``reach``, to a heading, else a paragraph, else a sentence; never inside a fence or table.

    Spans overlap by ``overlap`` characters; the start always advances.
    """
    n, at, out = len(text), 0, []
    guarded = [(b.start, b.end) for b in blocks(text) if b.atomic]
    while at < n:
        end = min(n, at + size)
        if end < n:
            floor = max(at + 1, end - reach)
            for pattern in (r"\n(?=#{1,6} )", r"\n\s*\n", r"(?<=[.!?。！？])\s+"):
                cuts = [m.end() for m in re.finditer(pattern, text[floor:end])]
                cuts = [floor + c for c in cuts if not any(a < floor + c < b for a, b in guarded)]
                if cuts:
                    end = cuts[-1]
                    break
            for a, b in guarded:
                if a < end < b:
                    end = a if a > at else min(b, n)
        out.append((at, end))
        if end >= n:
            break
        at = max(end - overlap, at + 1)
    return out


#: Weight of a boundary by what begins there.
WEIGHTS = {"h1": 100, "h2": 90, "h3": 80, "h4": 70, "h5": 60, "h6": 60, "block": 40, "sentence": 15}


def structure_spans(text: str, target: int, largest: int) -> list[tuple[int, int, str]]:
    """Tiles of the text that end at the weightiest boundary near the target size; blocks that must stay whole are cut only above ``largest``."""
    leafs = blocks(text)
    marks: dict[int, str] = {}
    for b in leafs:
        if b.kind == "heading":
            marks[b.start] = f"h{b.level}"
        elif b.kind not in ("blank",):
            marks.setdefault(b.start, "block")
        if b.kind == "paragraph":
            for m in re.finditer(r"(?<=[.!?。！？])\s+", text[b.start : b.end]):
                marks.setdefault(b.start + m.end(), "sentence")
    cuts = sorted(c for c in marks if 0 < c < len(text))
    out, at = [], 0
    while at < len(text):
        if len(text) - at <= largest:
            out.append((at, len(text), "doc_end"))
            break
        near = [c for c in cuts if at + target // 2 <= c <= at + largest]
        if near:
            best = max(near, key=lambda c: (WEIGHTS[marks[c]] - 60 * abs(c - at - target) / target, -c))
            out.append((at, best, marks[best]))
        else:
            best = at + largest
            out.append((at, best, "forced"))
        at = best
    return out


def frontmatter(text: str) -> tuple[dict, str]:
    """(meta, body); broken YAML gives an empty meta and the body behind it."""
    first = blocks(text)[:1]
    if not first or first[0].kind != "frontmatter":
        return {}, text
    raw = text[: first[0].end].strip()
    try:
        meta = yaml.safe_load("\n".join(raw.splitlines()[1:-1]))
    except yaml.YAMLError:
        meta = None
    return (meta if isinstance(meta, dict) else {}), text[first[0].end :]


def split_row(row: str) -> list[str]:
    """Cells of a table row; an escaped bar stays in its cell."""
    cells, cell, escaped = [], "", False
    for c in row.strip().strip("|"):
        if escaped:
            cell, escaped = cell + (c if c == "|" else "\\" + c), False
        elif c == "\\":
            escaped = True
        elif c == "|":
            cells, cell = [*cells, cell.strip()], ""
        else:
            cell += c
    return [*cells, (cell + "\\" * escaped).strip()]


def table_valid(block: str) -> bool:
    """A header, a rule of dashes and rows of equal width."""
    rows = [split_row(r) for r in block.strip().splitlines() if r.strip()]
    return len(rows) >= 3 and all(re.fullmatch(r":?-{3,}:?", c) for c in rows[1]) and len({len(r) for r in rows}) == 1


def strip_book_boilerplate(text: str) -> str:
    """What stands between the START and END markers of a public-domain book, if it has them; frontmatter is kept."""
    meta_end = blocks(text)[0].end if text.startswith("---") and blocks(text) and blocks(text)[0].kind == "frontmatter" else 0
    head, body = text[:meta_end], text[meta_end:]
    a = re.search(r"^\*{3}\s*START OF.*$", body, re.M | re.I)
    b = re.search(r"^\*{3}\s*END OF.*$", body, re.M | re.I)
    return head + body[a.end() if a else 0 : b.start() if b else len(body)].strip("\n") if a or b else text


#: Cleanup passes in their order: name, pattern, replacement.
PASSES = (
    ("zero_width", re.compile("[​‌‍﻿]"), ""),
    ("wikilink_newline", re.compile(r"(\[\[[^\[\]\n]*)[ \t]*\n[ \t]*(?=[^\[\]\n]+\]\])"), r"\1 "),
    ("bold_spacing", re.compile(r"\*\*[ \t]+([^*\n]+?)[ \t]*\*\*"), r"**\1**"),
    ("trailing_blanks", re.compile(r"[ \t]+$", re.M), ""),
    ("blank_lines", re.compile(r"\n{4,}"), "\n\n\n"),
)


def clean(text: str) -> tuple[str, list[tuple[str, int]]]:
    """The text after all passes, and (pass, number of repairs) of those that repaired anything; a fence left open is closed last."""
    fixes = []
    for name, pattern, new in PASSES:
        text, n = pattern.subn(new, text)
        if n:
            fixes.append((name, n))
    if sum(1 for line in text.splitlines() if line.strip().startswith("```")) % 2:
        text = text.rstrip("\n") + "\n```\n"
        fixes.append(("open_fence", 1))
    return text, fixes
