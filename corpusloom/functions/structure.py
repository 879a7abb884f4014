"""Structure kernels in plain Python: sections, headings of plain texts, numbered-line tables, glossaries, highlights."""

from __future__ import annotations

import re

from corpusloom.functions.markdown import blocks, split_row

#: What divisions of a book are called, and the signs of numbers in their headings.
DIVISIONS = ("CHAPTER", "PART", "SECTION", "BOOK")
DIVISION_SIGNS = "章回品節篇卷"
NUMERAL_SIGNS = "一二三四五六七八九十百千零〇0123456789"
ROMAN_SIGNS = "IVXLCDM"
#: Lines that name a table of contents.
CONTENTS = ("table of contents", "contents", "目錄", "目次")
GLOSSARY = re.compile(r"詞彙|術語|glossary|key terms", re.I)


def heading_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, heading): each heading's section up to the next heading of the same or a higher level."""
    heads = [b for b in blocks(text) if b.kind == "heading"]
    out, open_ = [], []
    for b in [*heads, None]:
        while open_ and (b is None or open_[-1].level >= b.level):
            h = open_.pop()
            out.append((h.start, b.start if b else len(text), h.level, h.heading))
        if b:
            open_.append(b)
    return sorted(out)


def names_division(line: str) -> bool:
    """Whether a line begins with a division's name and number, in English capitals or in Chinese."""
    head, _, rest = line.partition(" ")
    if head in DIVISIONS:
        number = rest.split(" ")[0].rstrip(".:,-–—") if rest else ""
        return number.isdecimal() or bool(number) and not number.strip(ROMAN_SIGNS)
    if line[:1] != "第":
        return False
    sign = line[1:].lstrip(NUMERAL_SIGNS)
    return len(sign) < len(line) - 1 and sign[:1] != "" and sign[0] in DIVISION_SIGNS


def all_capitals(line: str) -> bool:
    """Whether a line of 4 to 60 characters is a heading in capitals: ASCII letters, blanks and joining marks."""
    return 4 <= len(line) <= 60 and line[0].isupper() and all(c.isascii() and (c.isupper() or c in " &'-") for c in line)


def promote_headings(text: str) -> tuple[str, int]:
    """The text with division lines, and lines of capitals with a blank line beside them, as headings of level 2; texts with
    three headings or more stay as they are.  Also how many were promoted."""
    parts = blocks(text)
    if len([b for b in parts if b.kind == "heading"]) > 2:
        return text, 0
    out: list[str] = []
    promoted = at = 0
    for block in parts:
        out.append(text[at : block.start])
        at = block.end
        if block.atomic or block.kind == "heading":
            out.append(text[block.start : block.end])
            continue
        lines = text[block.start : block.end].splitlines(keepends=True)
        for n, raw in enumerate(lines):
            line = raw.rstrip("\r\n")
            edge = n == 0 or n == len(lines) - 1 or not lines[n - 1].strip() or not lines[n + 1].strip()
            title = line and line[0] != " " and line[-1] != " " and line.lower() not in CONTENTS
            if title and (names_division(line) or edge and all_capitals(line)):
                out.append("## ")
                promoted += 1
            out.append(raw)
    return "".join(out) + text[at:], promoted


def flatten_numbered_tables(text: str) -> tuple[str, int]:
    """Two-column tables whose first column numbers the lines of a page, as running text; other tables stay.

    Four fifths of the filled first cells must be digits and as many of the steps not falling; a word parted by a hyphen at
    a line's end is joined.
    """
    out, at, n = [], 0, 0
    for b in blocks(text):
        if b.kind != "table":
            continue
        rows = [split_row(r) for r in text[b.start : b.end].strip().splitlines()]
        data = [r for r in rows if not all(re.fullmatch(r":?-{2,}:?", c) for c in r)]
        first = [r[0] for r in data if r[0] not in ("", "-")]
        digits = [int(c) for c in first if c.isdigit()]
        steps = [y >= x for x, y in zip(digits, digits[1:])]
        if len(data) < 3 or any(len(r) != 2 for r in data) or len(digits) < 0.8 * len(first) or sum(steps) < 0.8 * len(steps):
            continue
        words = " ".join(r[1] for r in data if r[1] not in ("", "-"))
        out += [text[at : b.start], re.sub(r"(\w)- (?=[a-z])", r"\1", words), "\n"]
        at, n = b.end, n + 1
    return "".join(out) + text[at:], n


def take_glossary(text: str) -> tuple[str, list[list[str]]]:
    """The text without its glossary (a heading that names one, with the table below it) and the table's rows."""
    parts = blocks(text)
    for i, b in enumerate(parts):
        if b.kind == "heading" and GLOSSARY.search(b.heading):
            rest = [p for p in parts[i + 1 :] if p.kind != "blank"]
            if rest and rest[0].kind == "table":
                rows = [split_row(r) for r in text[rest[0].start : rest[0].end].strip().splitlines()]
                return text[: b.start] + text[rest[0].end :], rows[2:]
    return text, []


def highlight(text: str, spans: list[str], most: int = 5) -> tuple[str, int]:
    """The first place of each span outside the frontmatter in == marks; what is marked already, short or absent is left."""
    first = blocks(text)[:1]
    at = first[0].end if first and first[0].kind == "frontmatter" else 0
    head, body, n = text[:at], text[at:], 0
    for span in (s.strip() for s in spans):
        k = body.find(span) if len(span) >= 4 and "==" not in span and n < most else -1
        if k >= 0 and not body[:k].endswith("=="):
            body, n = f"{body[:k]}=={span}=={body[k + len(span):]}", n + 1
    return head + body, n
