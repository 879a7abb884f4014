"""Sentence boundaries across languages and scripts (problem 10).

Method: standard character-property sentence-break rules.  The terminator,
closing and opening character sets come from the Unicode ``Sentence_Break``
property (all scripts), with two additions the plain rules lack: suppression of
breaks after language-specific abbreviations, initials and ordinals, and
handling of quotations (a quotation inside a sentence does not end it).

Units are (start, end) code point ranges of the text, ends exclusive, without
surrounding blanks:

* a sentence of running text with its closing marks and quotes;
* the text of a heading without ``#`` marks;
* the text of a list item without marker or checkbox.

An empty line ends a unit, a single line break alone does not.  Front matter,
fenced code and table rows give none.  In Thai a blank between two Thai letters
separates sentences.

Defined results for odd input: null, empty and blank texts give no unit; equal
texts under several ids give the same units for each; extra columns are
ignored; an unclosed fence or front matter runs to the end of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Abbreviations that never end a sentence, lower case, without the last full stop.
NO_END = frozenset(
    """
    dr mr mrs ms prof st rev gen col lt sgt capt hon
    fig figs no nos sec secs ch vol ed eds pp cf vs approx ca al eq ref refs e.g i.e viz
    hr fr frl nr abb kap bd vgl bzw z.b d.h u.a z z.t d o.ä s.o s.u evtl ggf inkl tel str
    m mm mme mlle mgr env art p p.ex c.-à-d n° chap éd
    sr sra srta dra d.ª núm aprox p.ej ex pág págs cap ej ud uds av
    рис гл г гг стр с им т.е т.к напр см ср ул д-р проф акад
    डॉ श्री प्रो सं पं
    د أ م ص
    ดร ศ รศ ผศ พ.ศ ค.ศ อ นพ
    """.split()
)
#: Abbreviations that may end a sentence; they do before a capital.
MAY_END = frozenset("etc usw ff a.m p.m u.s u.k т.д т.п др jr sr. inc ltd co corp bspw".split())
#: Words after which a number with a full stop is a German ordinal.
ORDINAL_AFTER = frozenset("im am vom zum beim der dem den des die das ab bis seit zur nach jeder jeden".split())

_SMALL_WORD = re.compile(r"[^\W\d_][\w-]*")
#: Opening marks that close in some languages, and what opens there.
_CLOSES = {"\u201c": "\u201e", "\u2018": "\u201a", "\u00ab": "\u00bb", "\u2039": "\u203a"}

#: Sentences in Thai are parted by a blank between two of these.
_THAI = "\u0e01-\u0e3a\u0e40-\u0e4e"
_THAI_BLANK = re.compile(f"(?<=[{_THAI}])[ \\t\u00a0]+(?=[{_THAI}])")
_THAI_SET = frozenset(map(chr, [*range(0x0E01, 0x0E3B), *range(0x0E40, 0x0E4F)]))
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]+")
_HEAD_TAIL = re.compile(r"[ \t]+#+[ \t]*$")
_ITEM = re.compile(r"[ \t]*(?:[-*+\u2022]|(\d{1,9})[.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
_SPECIAL = frozenset("`~#|-*+\u2022 \t0123456789")


@lru_cache(maxsize=1)
def _rules() -> tuple[frozenset, frozenset, frozenset, frozenset]:
    """Hard terminators, all terminators, closing and opening marks, from the character properties of all scripts."""
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x20000)]))
    sterm = frozenset(regex.findall(r"\p{Sentence_Break=STerm}", every))
    close = frozenset(regex.findall(r"[\p{Pe}\p{Pf}\p{Pi}]", every)) | frozenset("\"')]*_")
    opening = frozenset("\"'([{*_\u00bf\u00a1") | frozenset(regex.findall(r"[\p{Ps}\p{Pi}]", every))
    return sterm, sterm | frozenset(".!?\u2026\uff0e\u2024"), close, opening


@lru_cache(maxsize=4096)
def _candidates(terms: frozenset, close: frozenset) -> re.Pattern:
    """Terminators, closing marks, blanks.  Of the marks a text holds only: small classes are searched much faster."""
    close_class = f"[{re.escape(''.join(sorted(close)))}]|" if close else ""
    return re.compile(f"([{re.escape(''.join(sorted(terms)))}]+)((?:{close_class}[ \u00a0\u202f][\u00bb\u203a])*)(\\s*)")


def _word_before(text: str, lo: int, i: int) -> str:
    """The run of letters, marks, full stops, hyphens before i, not beyond lo."""
    j = i
    while j > lo:
        c = text[j - 1]
        if c.isspace() or c in "([{\"'\u201c\u201e\u00ab\u00bf\u00a1\u2018\u300c\uff08,;:/|":
            break
        j -= 1
    return text[j:i]


def _begins_elsewhere(text: str, at: int) -> bool:
    """Whether the word in small letters at ``at``, such as a program's name, begins a paragraph or surely a sentence elsewhere in the text."""
    m = _SMALL_WORD.match(text, at)
    if not m:
        return False
    for found in re.finditer(rf"(?:(\w+)\.\s+|[!?]\s+|\A|\n\s*\n){re.escape(m.group())}(?![\w-])", text):
        before = (found.group(1) or "words").lower()
        if len(before) > 2 and not before.isdigit() and before not in NO_END and before not in MAY_END:
            return True
    return False


def _suppressed(text: str, lo: int, i: int, after: str, at: int) -> bool:
    """Whether the full stop at i, followed by blanks and then ``after``, belongs to an abbreviation, initial or ordinal."""
    word = _word_before(text, lo, i)
    if not word:
        return False
    low = word.lower().rstrip(".")
    if low in NO_END:
        return True
    if low in MAY_END:
        return after.islower() and not _begins_elsewhere(text, at)
    if "." in word and after.islower() and all(len(x) == 1 for x in word.rstrip(".").split(".")):
        return not _begins_elsewhere(text, at)
    if len(word) == 1 and word.isalpha():
        if not word.isupper() and not word.islower():  # no case: an initial in Arabic or Thai, but not an ideograph
            return not "\u3040" <= word <= "\ua4cf" and not "\u0900" <= word <= "\u0dff"
        if word.isupper():
            return True
        before = text[lo : i - 1].rstrip()[-2:].lower()  # spaced parts: z. B., т. д., p. ej.
        if before.endswith("."):
            return not (low == "\u0434" or low == "\u043f") or after.islower()
        return True
    if word.isdigit() and len(word) <= 2:
        head = text[lo : i - len(word)].rstrip()
        return _word_before(head, 0, len(head)).lower() in ORDINAL_AFTER
    if low == "ej" or low.endswith(("p.ej", "z.b", "d.h")):
        return True
    return False


def _sentences(text: str, a: int, b: int, cand: re.Pattern | None, out: list[tuple[int, int]]) -> None:
    """Append the sentences of running text in [a, b)."""
    sterm, _, _, opening = _rules()
    start = a
    for m in cand.finditer(text, a, b) if cand else ():
        (_, nxt_at), (t0, t1), (_, stop), _ = m.regs
        if nxt_at >= b:
            break
        nxt = text[nxt_at]
        last = text[t1 - 1]
        if last == "." and t1 - t0 == 1 and t1 == stop < nxt_at and nxt.isupper():
            # by far the most frequent case: a full stop, a blank, a capital
            word = text[max(text.rfind(" ", start, t0) + 1, start) : t0]
            if len(word) > 4 and word.islower() and word.isalpha() and word not in NO_END:
                out.append((start, t1))
                start = nxt_at
                continue
        closed = stop > t1
        if closed and text[stop - 1] in _CLOSES:  # these close what their counterpart opened, else they open
            k = stop
            while k > t1 and text[k - 1] in _CLOSES:
                low = text.rfind(_CLOSES[text[k - 1]], start, k)
                if low >= 0 and text.find(text[k - 1], low, k - 1) < 0:
                    break
                k -= 1
            if k < stop:
                stop = nxt_at = k
                nxt = text[k]
                closed = stop > t1
        spaced = nxt_at > stop
        if last in sterm:
            if closed and text[stop - 1] not in ")\uff09":
                # a quotation: it ends the sentence where a colon leads to it, or where it isn't the sentence's beginning and what follows isn't a particle
                if nxt in "\u3068\u3001\uff0c,;\uff1b\u2014" or nxt.islower():
                    continue
                if text[start] in opening:
                    continue
            elif nxt.islower() and closed:
                continue
        elif last in "!?":
            if nxt in ",;:\uff0c\u3001)\u2014\u2013" or nxt == "\u3068":
                continue
            if not spaced:
                if not (nxt.isupper() or nxt in opening and nxt not in "*_'\"" or (nxt.isalpha() and not nxt.islower() and not closed)):
                    continue
            elif nxt.islower():
                if closed or t1 - t0 > 3:
                    continue
            elif closed and text[start] in opening and not nxt.isupper() and nxt.isalpha():
                continue  # scripts without case: a quotation at the beginning is followed by who said it
        elif last == "\u2026" or t1 - t0 > 1:
            # an ellipsis ends a sentence only before a capital or an opening mark
            if not spaced or not (nxt.isupper() or nxt in opening):
                if not (m.group(1).strip(".") and m.group(1)[0] in "!?"):
                    continue
        else:  # a single full stop
            dot = t1 - 1
            if not spaced:
                if closed:
                    if nxt in ",;:" or not nxt.isupper():
                        continue
                    if text[stop - 1] in "*_":
                        continue
                else:
                    if not (nxt.isupper() or nxt in opening and nxt not in "*_'[("):
                        continue
                    word = _word_before(text, start, dot)
                    if len(word) < 2 or not word[-1].islower() and not word[-1].isdigit() and nxt.isupper() and not (word.isalpha()):
                        continue
                    if not (word.replace("-", "").replace("\u2019", "").isalpha() and word.lower() not in NO_END):
                        continue
                    if nxt_at + 1 < b and nxt.isupper() and text[nxt_at + 1].isupper():
                        continue
            else:
                if nxt in ",;:":
                    continue
                after = nxt
                if nxt in opening:
                    k = nxt_at
                    while k < b and (text[k] in opening or text[k].isspace()):
                        k += 1
                    after = text[k] if k < b else nxt
                if closed:
                    if after.islower() and nxt not in opening:
                        continue
                    if text[stop - 1] in ")\uff09]" and _suppressed(text, start, dot, after, nxt_at) and after.islower():
                        continue
                elif _suppressed(text, start, dot, after, nxt_at):
                    continue
        if start < stop:
            out.append((start, stop))
        start = nxt_at
    while b > start and text[b - 1].isspace():
        b -= 1
    if start < b:
        out.append((start, b))


def _thai_parts(text: str, units: list[tuple[int, int]], first: int) -> None:
    """Split the units from ``first`` on at blanks between Thai letters."""
    new = []
    for a, b in units[first:]:
        for m in _THAI_BLANK.finditer(text, a, b):
            new.append((a, m.start()))
            a = m.end()
        new.append((a, b))
    units[first:] = new


def scan(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, str]], list[int]]:
    """Units, headings (start of line, level, text) and the ends of empty lines of one text.

    The line grammar is that of Markdown blocks: front matter, fences, tables, headings, list items, paragraphs.
    """
    units: list[tuple[int, int]] = []
    heads: list[tuple[int, int, str]] = []
    empties: list[int] = []
    n, at, para, para_end, item = len(text), 0, -1, -1, -1
    fence = ""
    held = set(text)
    _, terms, close, _ = _rules()
    cand = _candidates(frozenset(held & terms), frozenset(held & close)) if held & terms else None
    if text.startswith("---") and text[3:].split("\n", 1)[0].strip() == "":
        k = text.find("\n")
        while k >= 0:
            e = text.find("\n", k + 1)
            line = text[k + 1 : e if e >= 0 else n]
            if line.rstrip() == "---":
                at = e + 1 if e >= 0 else n
                break
            k = e
        else:
            at = n

    def flush() -> None:
        nonlocal para, item
        if para >= 0:
            _sentences(text, para, para_end, cand, units)
            para = -1
        if item >= 0:
            b = para_end
            while b > item and text[b - 1].isspace():
                b -= 1
            if b > item:
                units.append((item, b))
            item = -1

    while at < n:
        e = text.find("\n", at)
        end = e if e >= 0 else n
        nxt = end + 1
        line = text[at:end]
        bare = line.strip()
        if fence:
            if bare.startswith(fence) and not bare.strip(fence[0]):
                fence = ""
            at = nxt
            continue
        if not bare:
            flush()
            empties.append(nxt if e >= 0 else n)
            at = nxt
            continue
        c = line[0]
        if c in _SPECIAL:
            f = bare[0]
            if f in "`~" and (m := _FENCE.match(line)) and not (f == "`" and "`" in m.group(2)):
                flush()
                fence = m.group(1)
                at = nxt
                continue
            if f == "#" and (m := _HEAD.match(line)):
                flush()
                a = at + m.end()
                t = _HEAD_TAIL.sub("", text[a:end].rstrip())
                heads.append((at, len(m.group(1)), t.strip()))
                if t:
                    units.append((a, a + len(t)))
                at = nxt
                continue
            if f == "|":
                flush()
                at = nxt
                continue
            if m := _ITEM.match(line):
                number = m.group(1)
                ends = para < 0 or not number or text[at - 1 : at] == "\n" and text[para:para_end].rstrip()[-1:] in ".!?:\u3002\uff01\uff1f\u0964\u061f\u2026\u201d\""
                if ends and m.end() < len(line):
                    flush()
                    item, para_end = at + m.end(), end
                    at = nxt
                    continue
            if bare in ("---", "***", "___"):
                flush()
                at = nxt
                continue
        if item >= 0:
            para_end = end
        else:
            if para < 0:
                para = at + len(line) - len(line.lstrip())
            para_end = end
        at = nxt
    flush()
    if units and held & _THAI_SET:
        _thai_parts(text, units, 0)
    return units, heads, empties


def units_of(text: str | None) -> list[tuple[int, int]]:
    """The sentence units of one text."""
    return scan(text)[0] if text else []


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit: (doc_id, unit_start, unit_end).  No shuffle: each text is read once where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, flat = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                u = scan(text)[0] if text else ()
                counts.append(len(u))
                flat.extend(u)
            rep = pa.array(np.repeat(np.arange(len(counts)), counts))
            pairs = np.array(flat, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.take(rep), pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())],
                names=["doc_id", "unit_start", "unit_end"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, unit_start bigint, unit_end bigint")
