"""Page boilerplate mixed with main content (problem 1).

Method: line-block distribution.  Markup is stripped, text lengths are summed over sliding windows of lines, and the
main body lies between the points where the sums surge and dive.  What surges and dives is told by the page's own mean sum:
the body begins and ends where sums around one of the mean fall under a share of it, and short lines that are no
sentence, list item, subhead or table row don't begin or end it.  Lines that are furniture by themselves have no weight in
the sums, wherever they stand, so notices inside an article don't end it and menus don't begin one.  No list of phrases is
given; what furniture is comes from the pages:

* phrases (whole lines, parts of menus, several joined in one line) that surely a share of a language's articles hold, or a
  share of the articles of the page's own site (domains and digits masked);
* breadcrumbs of such phrases, dates alone in a line, copyright lines, lines that are one link;
* lists of single lines, as teasers of other articles are, after a heading that is such a phrase, up to the page's own title,
  its excerpt or running text of several sentences.

The snippet is judged by the same phrases; what is left of it is its excerpt.

Defined results: null and empty fields give nothing; blank lines are never listed; repeated rows give their lines once.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.language import language
from corpusloom.llm.sentences import units_of
from corpusloom.session import Stages

#: Lines in a window of the distribution; the body has windows of SURGE times the page's mean sum and goes on to DIVE times it.
WINDOW = 5
SURGE = 1.0
DIVE = 0.2
#: Share of the length of the page's mean line, weighed by length, under which a line is light.
LIGHT = 0.15
#: Share of a language's articles from which a phrase is furniture; the lower bound of its share at Z deviations must reach it.
COMMON, Z = 0.03, 1.96
#: Share of a site's articles from which a phrase is furniture there, and the least number of articles that hold it.
SITE_COMMON = 0.2
SITE_LEAST = 3
#: Keys of all sites up to which they are sent to every task (8 bytes each).
BROADCAST_KEYS = 2_000_000

_TAG = re.compile(r"<[^<>]+>")
_LINKED = re.compile(r"(?:<li>\s*)?<a\s[^<>]*>.*</a>(?:\s*</li>)?", re.I)
_SEPARATOR = re.compile(r"\s*[·|›»>/]\s*|\s{2,}|\t")
_PLACES = re.compile(r"\s*[›»>/]\s*")
_BULLET = re.compile(r"^[•·]\s*")
_DIGITS = re.compile(r"\d+")
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}|\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}\.? [^\W\d_]{3,9}\.? \d{4}|[^\W\d_]{3,9} \d{1,2}, \d{4}")
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright)\s*\d{4}", re.I)
_STOPS = re.compile(r"[.!?…]+[\"'”’»)]*(?=\s|$)|[。！？]")
_MARKED = re.compile(r"#{1,6} |[-*+] |\d+[.)] ")


def clean(line: str) -> str:
    """Markup and entities away, blanks trimmed."""
    if "<" in line:
        line = _TAG.sub(" ", line)
    return (html.unescape(line) if "&" in line else line).strip()


def _masked(phrase: str, site: str) -> str:
    p = phrase.replace(site, "~") if site else phrase
    return _DIGITS.sub("0", _BULLET.sub("", p)).strip().lower()


def phrases(line: str, site: str) -> list[str]:
    """The masked phrases of a line whose frequency counts, of any length: the line, and the parts of a menu (a breadcrumb's last part is a title)."""
    masked = (_masked(p, site) for p in (line, *_SEPARATOR.split(line)[:-1]) if p)
    return [m for m in masked if any(c.isalpha() for c in m)]


OTHER, OWN, FURNITURE = 0, 1, 2
#: Words of the longest phrase sought inside a line; whole lines and parts of menus are of any length.
WORDS = 24
_OUTER = " ·|•/>»›-–—*[]()"


def _key(lang: str, phrase: str) -> int:
    """Of a language's phrase, or with '' of a site's."""
    key = xxhash.xxh3_64_intdigest(phrase) - (1 << 63)
    return _of_language(lang, key) if lang else key


def _of_language(lang: str, key: int) -> int:
    return key ^ (xxhash.xxh3_64_intdigest(lang) >> 1)


class _Judge:
    """Tells furniture lines of one page; ``common``: keys of a language's phrases, and of a site's (see ``_key``)."""

    def __init__(self, site: str, title: str, lang: str, common: Container[int]):
        self.site, self.title = site, title
        self.of_language, self.of_site = (common.one, common.other) if isinstance(common, _Either) else (common, common)
        self.mark = _of_language(lang, 0)

    def known(self, masked: str) -> bool:
        key = _key("", masked)
        return key in self.of_site or key ^ self.mark in self.of_language

    def phrase(self, p: str) -> bool:
        m = _masked(p, self.site)
        return not m or bool(_COPYRIGHT.match(p) or _DATE.fullmatch(p)) or self.known(m)

    def furniture(self, line: str) -> bool:
        if self.phrase(line):
            return True
        parts = [p for p in _SEPARATOR.split(line) if p]
        if len(parts) > 1:
            known = [self.phrase(p) for p in parts]
            if all(known):
                return True
            # breadcrumb: known places, then the beginning of a title
            if all(known[:-1]) and (not self.title or self.title.startswith(parts[-1].rstrip(".… "))):
                return True
        return self.joined(line)

    def joined(self, line: str) -> bool:
        """Whether known phrases follow one another in the line; the last may be cut, if they cover most of it."""
        words = _masked(line, self.site).split()
        at, done = 0, 0
        of_site, of_language, mark = self.of_site, self.of_language, self.mark
        while at < len(words):
            # the longest known phrase from here on, by a running hash
            hashed, best, first = xxhash.xxh3_64(words[at]), 0, words[at].lstrip(_OUTER)
            bare = xxhash.xxh3_64(first) if first != words[at] else None
            for end in range(at + 1, min(len(words), at + WORDS) + 1):
                if end > at + 1:
                    hashed.update(" " + words[end - 1])
                    if bare:
                        bare.update(" " + words[end - 1])
                key = hashed.intdigest() - (1 << 63)
                if key in of_site or key ^ mark in of_language:
                    best = end
                elif bare or words[end - 1][-1] in _OUTER:
                    if self.known(" ".join(words[at:end]).strip(_OUTER)):
                        best = end
            if not best:
                break
            at, done = best, done + 1
        return at == len(words) or done > 1 and 2 * len(" ".join(words[:at])) > len(" ".join(words))


def _several(line: str) -> bool:
    """Whether the line is running text of more than one sentence."""
    return len(line) >= 30 and len(_STOPS.findall(line)) >= 2 and len(units_of(line)) >= 2


def _crumb(texts: list[str], judge: _Judge) -> str:
    """The last place of a page's breadcrumb, the beginning of its title; '' without one."""
    for t in texts:
        parts = _PLACES.split(t)
        if len(parts) > 1 and not judge.phrase(parts[-1]) and all(judge.phrase(p) for p in parts[:-1]):
            return parts[-1].rstrip(".… ")
    return ""


def _single(line: str) -> bool:
    """Whether the line is at most one sentence, and no list item, subhead or table row."""
    return not (_several(line) or _MARKED.match(line) or " | " in line)


def _listed(texts: list[str], kinds: list[int], k: int) -> bool:
    """Whether line k, after furniture, begins a list of teasers: single lines up to furniture, the page's end or its own lines, or two lines at least."""
    run = 0
    for j in range(k, len(texts)):
        if not texts[j]:
            continue
        if kinds[j] != OTHER:
            break
        if not _single(texts[j]):
            return run > 1
        run += 1
    return True


def body_lines(lines: list[str], site: str, title: str, excerpt: str, common: Container[int], lang: str) -> set[int]:
    """The numbers of the non-blank lines that are main body."""
    judge = _Judge(site, title, lang, common)
    texts = [clean(x) for x in lines]
    length = np.zeros(len(lines), dtype=np.int64)
    # the body can't begin before the page's own title, where the page has it as a line
    first = next((k for k, t in enumerate(texts) if t and t.lstrip("# ").strip() == title), -1) if title else -1
    if not title and (crumb := _crumb(texts, judge)):
        # without a title the breadcrumb's last place tells how it begins
        first = next((k for k, t in enumerate(texts) if t.lstrip("# ").startswith(crumb)), -1)
    kinds = [OTHER] * len(texts)
    for k, t in enumerate(texts):
        if k == first or excerpt and len(t) > 8 and (excerpt.startswith(t) or t.startswith(excerpt)):
            kinds[k] = OWN
        elif t and (_LINKED.fullmatch(lines[k].strip()) or judge.furniture(t)):
            kinds[k] = FURNITURE
    after = listed = False  # furniture: titles of other articles may follow
    for k, t in enumerate(texts):
        if not t or k < first:
            continue
        if kinds[k] == FURNITURE:
            after = not _closed(t) and len([p for p in _SEPARATOR.split(t) if p]) < 2  # a heading, no notice and no menu
            continue
        if after and kinds[k] == OTHER and _single(t) and (listed := listed or _listed(texts, kinds, k)):
            continue
        after = listed = False
        length[k] = len(t)
    # the line-block distribution over non-blank lines: means of windows, surge and dive
    at = [k for k, t in enumerate(texts) if t]
    if not length.any():
        return set()
    own = length[at]
    half = WINDOW // 2
    total = np.concatenate([np.zeros(half + 1, dtype=np.int64), np.cumsum(own), np.full(half, own.sum())])
    # at the edges a window has fewer lines
    place = np.arange(len(own))
    sums = (total[WINDOW:] - total[:-WINDOW]) / (np.minimum(place, half) + np.minimum(len(own) - 1 - place, half) + 1)
    mean = sums[sums > 0].mean()
    # the line that the page's mean character stands in: many short lines don't pull it down
    light = LIGHT * (own * own).sum() / own.sum()
    # lines known as furniture don't stop the body, nor does a sentence standing among them
    on = (sums >= DIVE * mean) | (own == 0) | np.array([own[j] >= light and bool(_STOPS.search(texts[k][-8:])) for j, k in enumerate(at)])
    high = np.flatnonzero(sums >= SURGE * mean)
    start, stop = int(high[0]), int(high[-1])
    while start > 0 and on[start - 1]:
        start -= 1
    while stop + 1 < len(at) and on[stop + 1]:
        stop += 1
    if first >= 0:
        start = at.index(first)
    body = [k for k in at[start : stop + 1] if length[k]]
    # a window also holds lines beyond the last paragraph: light ones at either end are no body, but for a title the page doesn't tell
    heavy = [j for j, k in enumerate(body) if k == first or length[k] >= light or _closed(texts[k])]
    if not heavy:
        return set(body)
    begin = heavy[0] - 1 if heavy[0] and not title and first < 0 else heavy[0]
    return set(body[begin : heavy[-1] + 1])


def _closed(line: str) -> bool:
    """Whether a line, however short, is a sentence, list item, subhead or table row."""
    return bool(_MARKED.match(line) or " | " in line or _STOPS.search(line[-8:]))


def _excerpt(snippet: str, site: str, title: str, common: Container[int], lang: str) -> str:
    judge = _Judge(site, title, lang, common)
    for x in snippet.split("\n"):
        t = clean(x)
        if t and t != title and not judge.furniture(t):
            return t
    return ""


def furniture(item: int, site: str | None, title: str | None, snippet: str | None, content: str | None, common: Container[int]) -> list[tuple[int, str, int]]:
    """(item_id, field, line_no) of the non-blank lines that aren't main body."""
    out: list[tuple[int, str, int]] = []
    site, title = (site or "").strip(), clean(title or "")
    lang = language(content or snippet or "")
    excerpt = _excerpt(snippet, site, title, common, lang) if snippet else ""
    if content:
        lines = content.split("\n")
        body = body_lines(lines, site, title, excerpt, common, lang)
        out += [(item, "content", k) for k, x in enumerate(lines) if k not in body and x.strip()]
    if snippet:
        judge = _Judge(site, title, lang, common)
        for k, x in enumerate(snippet.split("\n")):
            t = clean(x)
            if x.strip() and (not t or judge.furniture(t)):
                out.append((item, "snippet", k))
    return out


def held_phrases(pages: DataFrame) -> DataFrame:
    """(lang, site, article, phrase), once each and written; phrase null tells of the article itself.

    Articles, not pages, hold phrases, since a page crawled twice repeats its article: pages of one title, or without one of
    one dedupe_key where the table has it, are one.  Keys are 64-bit hashes, so length costs no memory.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for site, article, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name, lang = site.strip(), language(content)
                rows.add((lang, site, article, None))
                for x in set(content.split("\n")):
                    rows.update((lang, site, article, _key("", m)) for m in phrases(clean(x), name))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "site", "article", "phrase"])

    named = F.when(F.trim("title") != "", F.trim("title"))
    other = [F.col(c).cast("string") for c in ("dedupe_key", "item_id") if c in pages.columns]
    own = pages.filter("content != ''").select(F.coalesce("site", F.lit("")).alias("site"), F.xxhash64(F.coalesce(named, *other)).alias("article"), "content")
    held = own.mapInArrow(count, "lang string, site string, article bigint, phrase bigint")
    return Stages(pages.sparkSession, "phrases").cut(held.groupBy("lang", "site", "article", "phrase").agg(F.lit(1).alias("one")).drop("one"))


def lower_bound(n: Column, of: Column) -> Column:
    """Wilson's lower bound of a share n / of, so that a few pages prove little and no count need be asked for."""
    p = n / of
    return (p + Z * Z / (2 * of) - Z * F.sqrt(p * (1 - p) / of + Z * Z / (4 * of * of))) / (1 + Z * Z / of)


def common_phrases(held: DataFrame) -> frozenset:
    """Keys of the phrases of which surely COMMON of a language's articles hold, on more than one site or not.

    At most (phrases of an article) / COMMON keys per language can pass, so the set that goes to the driver and to all
    executors is bounded, whatever the number of pages.
    """
    n = held.groupBy("lang", "phrase").agg(F.count("*").alias("n"))
    total = n.filter("phrase IS NULL").select("lang", F.col("n").alias("articles"))
    some = n.filter("phrase IS NOT NULL AND n > 1").join(F.broadcast(total), "lang").filter(lower_bound(F.col("n"), F.col("articles")) >= COMMON)
    return frozenset(_of_language(r.lang, r.phrase) for r in some.select("lang", "phrase").collect())


class _Either:
    """Keys of one set or another."""

    def __init__(self, one: Container[int], other: Container[int]):
        self.one, self.other = one, other

    def __contains__(self, key: int) -> bool:
        return key in self.one or key in self.other


def site_phrases(held: DataFrame) -> DataFrame:
    """(site, keys): the phrases that at least SITE_COMMON of a site's articles hold, of the sites that have any.  A site has at
    most (phrases of an article) / SITE_COMMON keys."""
    n = held.filter("trim(site) != ''").groupBy("site", "phrase").agg(F.count_distinct("article").alias("n")).filter((F.col("n") >= SITE_LEAST) | F.col("phrase").isNull())
    per = n.filter("phrase IS NULL").select("site", F.col("n").alias("articles"))
    some = n.filter("phrase IS NOT NULL").join(per.filter(F.col("articles") >= SITE_LEAST), "site").filter(F.col("n") >= SITE_COMMON * F.col("articles"))
    return some.groupBy("site").agg(F.collect_list("phrase").alias("keys"))


def _with_phrases(pages: DataFrame, held: DataFrame) -> DataFrame:
    """(item_id, site, title, snippet, content, keys) of the pages, with the phrases of their sites."""
    cols = pages.select(F.col("item_id").cast("bigint"), "site", "title", "snippet", "content")
    sites = Stages(pages.sparkSession, "sites").cut(site_phrases(held))
    # the pages stay where they lie if the keys of all sites are few; else both sides meet by site
    keys = sites.agg(F.sum(F.size("keys"))).first()[0] or 0
    return cols.join(F.broadcast(sites) if keys <= BROADCAST_KEYS else sites, "site", "left").select("item_id", "site", "title", "snippet", "content", "keys")


def _judged(batch: pa.RecordBatch, common: frozenset) -> Iterator[tuple[tuple, list[tuple[int, str, int]]]]:
    """Each page of a batch of ``_with_phrases`` and its lines that aren't main body."""
    sites: dict[str | None, frozenset] = {}
    names, keys = batch.column(1).to_pylist(), batch.column(5)
    for k, page in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
        if names[k] not in sites:
            sites[names[k]] = frozenset(keys[k].as_py() or ())
        yield page, furniture(*page, _Either(common, sites[names[k]]))


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(item_id, field, line_no) of every non-blank line that isn't main body."""
    held = held_phrases(pages)
    shared = pages.sparkSession.sparkContext.broadcast(common_phrases(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, found in _judged(batch, shared.value):
                rows += found
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32())], names=["item_id", "field", "line_no"]
            )

    return _with_phrases(pages, held).mapInArrow(run, "item_id bigint, field string, line_no int").distinct()


def main_bodies(pages: DataFrame) -> DataFrame:
    """(item_id, content, snippet) with only the main body's lines, markup stripped; null stays null."""
    held = held_phrases(pages)
    shared = pages.sparkSession.sparkContext.broadcast(common_phrases(held))

    def keep(text: str | None, gone: set[int]) -> str | None:
        return None if text is None else "\n".join(clean(x) for k, x in enumerate(text.split("\n")) if k not in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for (item, _, _, snippet, content), rows in _judged(batch, shared.value):
                out[0].append(item)
                out[1].append(keep(content, {k for _, f, k in rows if f == "content"}))
                out[2].append(keep(snippet, {k for _, f, k in rows if f == "snippet"}))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["item_id", "content", "snippet"])

    return _with_phrases(pages, held).mapInArrow(run, "item_id bigint, content string, snippet string")
