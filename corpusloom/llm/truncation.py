"""Text cut off by field limits (problem 5).

Method: right-censored length distributions combined, value by value, with the evidence of the ending.

* Lengths.  Per source (stage) the lengths of the distinct values, in characters and in recorded tokens, are log-normal up
  to limits at which they are cut.  A candidate limit is a length with more values than those around it explain (Poisson
  likelihood-ratio test); maximum likelihood with the values there as censored tells what share of them is censored.
* Tokens.  The recorded tokens tell how long a value was before its field or transfer cut it: the ratio to the tokens its
  text has is normal within a source for whole values and has no upper bound for cut ones.
* Endings.  A text ends whole, broken (an open bracket, fence, quotation or sentence, a marker) or open, without a full
  stop.  Whether an open tail, the last two words of a line (three characters in scripts without blanks), is an ending
  comes from the corpus: how often lines of its kind end so, how often it stands inside a line, and how often it is the
  beginning of longer words.  The latter comes from sorting all tails and comparing neighbours' common prefixes: ``rejected
  hy`` is followed by ``rejected hypothesis``.

Expectation maximisation over counts (limit, kind of ending, likelihood ratio) gives the share of cut values at each limit
and elsewhere in each source, with the censored share as its prior; each value's posterior is its prior odds times its
likelihood ratios.  Values with a posterior over one half are cut.

Defined results: null, empty and blank texts are not cut, nor are placeholders and error messages (they hold no text); null
sources are one source, ``unknown``.  Repeated rows of a call count once, the one ingested last holds; null and blank ids
give nothing.

Costs: one pass over the texts; tails are added up in each task before the shuffle.  The driver sees sums per source.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.ids import clean_id
from corpusloom.llm.sentences import MAY_END, NO_END, units_of
from corpusloom.session import Stages

#: A candidate limit: twice the log-likelihood ratio of its count against the mean of the lengths within AROUND of it.
SPIKE_TEST, SPIKE_AROUND = 24.0, 12
#: Weight of the fit's censored share as a prior at a limit, in values.
PRIOR = 10.0
#: Shape of the prior of a tail's rate of endings: small, as most tails end no line.
SHAPE = 0.3
#: Taken off the ends seen of a tail, for those not seen.
DISCOUNT = 0.5
#: Chance that a cut at a random character or token leaves a whole ending, by kind of place (limits in characters, in tokens, none).
BY_CHANCE = {"c": 0.02, "t": 0.06, "": 0.02}
#: Tail counts a task holds before it gives them out.
HELD = 500_000

NATURAL, CUT, OPEN_TAIL = "natural", "cut", "tail"
#: Kinds of lines without a full stop: running text, list items and headings, keywords, and texts of one line.
KINDS = ("open0", "open1", "open2", "open3")
CLASSES = (CUT, NATURAL, *KINDS)

_DIGITS = re.compile(r"\d+")
_CLOSERS = "\"'”’»」』)]）*_"
_STOPS = frozenset(".!?…。！？।؟")
_MARKERS = ("…", "...", "�", "[truncated]", "[cut]", "[…]", "[...]", "(truncated)", "(cut)", "<truncated>", "<cut>")
_CJK = re.compile(r"[぀-ヿ一-鿿]")
_STOPPED = re.compile(r"[.!?][\"'”’»)]*\s")
_ITEM = re.compile(r"(?:[-*+•]|\d+[.)]|#{1,6})\s")
_QUOTES = (("“", "”"), ("「", "」"), ("«", "»"), ("(", ")"), ("（", "）"))
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_NUMBERED = re.compile(r"\d\)")
#: Abbreviations after which a number follows or goes on.
_BEFORE_NUMBER = ("fig.", "abb.", "im", "am", "nr.", "no.", "sec.")


def stopped(text: str) -> bool:
    """Whether a text ends with a full stop, perhaps closed by quotes, brackets or emphasis."""
    return text.rstrip(_CLOSERS)[-1:] in _STOPS


def keywords(line: str) -> list[str]:
    """The items of a line of keywords: three or more, of up to four words each; else none."""
    parts = line.split(", ")
    return [p for p in parts if p] if len(parts) >= 3 and all(len(p.split()) <= 4 for p in parts) else []


def _json_done(text: str) -> bool | None:
    """Whether the JSON the text begins with is complete; None if it isn't JSON."""
    t = text.strip()
    fenced = re.match(r"```(?:json)?\s*", t)
    body = t[fenced.end() :] if fenced else t
    if body[:1] not in ("[", "{"):
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(body)
    except ValueError:
        return False
    rest = body[end:].strip()
    if fenced:
        if not rest.startswith("```"):
            return False
        rest = rest[3:].strip()
    return True if not rest else None


def ending(text: str) -> str:
    """How the text ends: NATURAL, CUT, or OPEN_TAIL (the corpus decides)."""
    t = text.strip()
    if not t:
        return NATURAL
    if t.lower().endswith(_MARKERS) and any(c.isalnum() for c in t):
        return CUT
    done = _json_done(t)
    if done is not None:
        return NATURAL if done else CUT
    if t.count("```") % 2 or t.endswith("``") and not t.endswith("```"):
        return CUT
    if t.endswith("```"):
        return NATURAL
    last = t[t.rfind("\n") + 1 :].strip()
    if last.startswith("|"):
        rows = [x.strip() for x in t.split("\n") if x.strip().startswith("|")]
        return NATURAL if len(last) > 1 and last.endswith("|") and last.count("|") >= rows[0].count("|") else CUT
    if stopped(t):
        for left, right in _QUOTES:
            at = last.rfind(left)
            if left == "“" and "„" in last:  # there it closes
                continue
            if at >= 0 and last.find(right, at) < 0 and not (left == "(" and _NUMBERED.search(last)):
                return CUT
        if last.count('"') % 2:
            return CUT
        if t.endswith("."):
            words = last[:-1].split()
            word = words[-1].lstrip("([\"'“„«") if words else ""
            low = word.lower()
            if low in NO_END and low not in MAY_END and low not in ("no", "al", "art", "sec", "il", "is"):
                return CUT
            if len(word) == 1 and word.isalpha() and word.isascii():
                return CUT
            if len(words) > 1 and word.isdigit() and words[-2].lower() in _BEFORE_NUMBER:
                return NATURAL if words[-2].lower() not in ("im", "am") else CUT
            if word[-1:].isdigit():
                return OPEN_TAIL  # a full stop, or a decimal point
        return NATURAL
    if not _ITEM.match(last) and (_STOPPED.search(last) or _CJK.search(last) and any(c in last for c in "。！？")):
        units = units_of(last)
        if len(units) > 1 and stopped(last[units[-2][0] : units[-2][1]]):
            return CUT  # running text that stops within a sentence
    return OPEN_TAIL


def _base(word: str) -> str:
    """A word without the marks that may follow it before a line goes on."""
    return word if word[-1:].isalnum() else word.rstrip(".,;:!?…\"'”’»)]*_") or word


def _plain_tail(masked: str) -> str:
    """The last two words of a line with masked digits; three characters in scripts without blanks."""
    if _CJK.search(masked[-2:]):
        return masked[-3:]
    words = masked.split()
    if not words:
        return ""
    last = words[-1] if words[-1][-1:] == "." and words[-1][-2:-1] == "0" else _base(words[-1])
    return f"{_base(words[-2])} {last}" if len(words) > 1 else f"^ {last}"


def open_tail(text: str) -> tuple[int, str]:
    """(kind, tail) of a text that ends OPEN_TAIL."""
    t = text.rstrip()
    last = _DIGITS.sub("0", t[t.rfind("\n") + 1 :].rpartition("```")[2].strip())
    parts = keywords(last)
    if parts:
        return 2, _plain_tail(parts[-1])
    return (1 if _ITEM.match(last) else 0 if "\n" in t.strip() else 3), _plain_tail(last)


class Tails:
    """Counts of tails: ends of lines inside texts by kind, ends of texts by kind, and places inside lines."""

    def __init__(self) -> None:
        self.ends, self.final, self.inner = tuple(Counter() for _ in range(3)), tuple(Counter() for _ in KINDS), Counter()

    def add(self, text: str, how: str) -> None:
        """Counts a text that ends ``how``; where it was broken its last tail is none."""
        if how == OPEN_TAIL:
            kind, tail = open_tail(text)
            self.final[kind][tail] += 1
        if text.lstrip()[:1] in "[{|<":
            return
        if "```" in text:
            text = _FENCED.sub("\n", text)
        lines = _DIGITS.sub("0", text.rstrip()).split("\n")
        for n, line in enumerate(lines):
            line = line.strip()
            if not line:
                continue
            inside, open_ = n + 1 < len(lines), not stopped(line)
            if _CJK.search(line):
                self.inner.update(line[i : i + 3] for i in range(len(line) - 3))
                if inside and open_:
                    self.ends[1 if _ITEM.match(line) else 0][_plain_tail(line)] += 1
                continue
            parts = keywords(line) if open_ else []
            if parts:
                self.ends[2].update(_plain_tail(p) for p in (parts if inside else parts[:-1]))
                continue
            words = line.split()
            bases = [w if w[-1].isalnum() else _base(w) for w in words]
            pairs = ["^ " + bases[0], *map(" ".join, zip(bases, bases[1:]))]
            self.inner.update(pairs[:-1] if open_ else pairs)
            if "0." in line:  # numbers before a full stop that something follows
                self.ends[0].update(f"{bases[i - 1]} {w}" for i, w in enumerate(words) if i and w.endswith("0.") and (i + 1 < len(words) or inside))
            if inside and open_:
                self.ends[1 if _ITEM.match(line) else 0][_plain_tail(line)] += 1

    def rows(self) -> pa.RecordBatch:
        every = (*self.ends, *self.final, self.inner)
        keys = list(dict.fromkeys(k for c in every for k in c))
        cols = [pa.array([c.get(k, 0) for k in keys], pa.int64()) for c in every]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *cols], names=["tail", *_COUNTS])

    def __len__(self) -> int:
        return len(self.inner) + sum(map(len, self.ends)) + sum(map(len, self.final))


_COUNTS = ("e0", "e1", "e2", "f0", "f1", "f2", "f3", "inside")
_TAILS = "tail string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
#: What ``judged`` needs of a value: ``own`` tells that it holds a text of its own.
EVIDENCE = "own boolean, how string, kind int, tail string, chars bigint, own_tokens double, blank boolean"


def evidence(text: str | None, own: bool) -> tuple:
    """(own, how, kind, tail, chars, own_tokens, blank): how a value ends, how many tokens it has, a quarter of its letters or
    one a wide character, and whether a blank is left at its end."""
    if not own or not text:
        return False, None, None, None, len(text or ""), None, False
    how = ending(text)
    kind, tail = open_tail(text) if how == OPEN_TAIL else (None, None)
    wide = 0 if text.isascii() else len(text) - len(_WIDE.sub("", text))
    return True, how, kind, tail, len(text), (len(text) - wide) / 4 + wide, text.endswith(" ")


_WIDE = re.compile(r"[⺀-\U0003ffff]")


def scan(rows: DataFrame, keep: str, width: int, text_at: int, features: Callable, names: str) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts, written: (features, tail counts).

    ``features(row)`` gives the values of the columns ``names`` beside the first ``width`` columns that are kept as they are
    (``keep``), among them ``how``.
    """
    columns = [x.strip().split()[0] for x in names.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    types = [kinds[x.strip().split()[1]] for x in names.split(",")]
    how_at, schema = columns.index("how"), f"{keep}, {names}, counts struct<{_TAILS.replace(' ', ':').replace(',:', ',')}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails, kept, blank = Tails(), None, None
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            texts = batch.column(text_at).to_pylist()
            for values, text in zip(zip(*(batch.column(i).to_pylist() for i in range(width, batch.num_columns))), texts):
                row = features(*values)
                for col, v in zip(out, row):
                    col.append(v)
                if row[how_at] is not None:
                    tails.add(text, row[how_at])
            kept = [batch.column(i) for i in range(width)]
            blank = [c.type for c in kept]
            yield from _with_counts(kept, [pa.array(c, t) for c, t in zip(out, types)], None, fields)
            if len(tails) > HELD:
                yield from _with_counts(blank, types, tails.rows(), fields)
        if blank and len(tails):
            yield from _with_counts(blank, types, tails.rows(), fields)

    fields = [x.strip().split()[0] for x in keep.split(",")] + columns + ["counts"]
    written = Stages(rows.sparkSession, "endings").cut(rows.mapInArrow(run, schema))
    return written.filter("counts IS NULL").drop("counts"), written.filter("counts IS NOT NULL").select("counts.*")


def _with_counts(kept: list, own: list, counts: pa.RecordBatch | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("tail", pa.string()), *[(c, pa.int64()) for c in _COUNTS]])
    if counts is None:
        yield pa.RecordBatch.from_arrays([*kept, *own, pa.nulls(len(own[0]), kind)], names=names)
    else:
        n = counts.num_rows
        yield pa.RecordBatch.from_arrays([*[pa.nulls(n, t) for t in (*kept, *own)], pa.StructArray.from_arrays(counts.columns, fields=list(kind))], names=names)


def longer_words(counts: DataFrame) -> DataFrame:
    """The tails at which texts end, with ``longer``: how often a tail is the beginning of longer words.

    Tails of one first word and next letter are sorted; a tail is followed by all that begin with it, so a stack of
    beginnings takes each count once.  Masked numbers go on after their decimal point.
    """
    total = counts.groupBy("tail").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    first = F.concat(F.substring_index("tail", " ", 1), F.lit(" "), F.substring(F.expr("substring(tail, length(substring_index(tail, ' ', 1)) + 2)"), 1, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []
        done: list[list] = []

        def close() -> None:
            row = stack.pop()
            if stack and _goes_on(stack[-1][0], row[0]):  # what begins with this begins with what this begins with
                stack[-1][-1] += row[-1] + sum(row[1:-1])
            if any(row[4:8]):
                done.append(row)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                while stack and not row[0].startswith(stack[-1][0]):
                    close()
                stack.append([*row, 0])
            yield _longer(done)
            done.clear()
        while stack:
            close()
        yield _longer(done)

    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return total.repartition(n, first).sortWithinPartitions("tail").mapInArrow(run, f"{_TAILS}, longer bigint")


def _goes_on(short: str, long: str) -> bool:
    return long[len(short) : len(short) + 1].isalnum() and not _CJK.search(short[-1:])


def _longer(rows: list[list]) -> pa.RecordBatch:
    cols = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(len(_COUNTS) + 2)]
    return pa.RecordBatch.from_arrays(cols, names=["tail", *_COUNTS, "longer"])


def tail_ratios(counts: DataFrame, chars: int, cut_rate: float) -> DataFrame:
    """(tail, r0..r3): log of P(tail | cut anywhere) / P(tail | a line of that kind ends), of the tails at which texts end.

    A cut falls on any of ``chars`` places.  Ends are counted with a discount; a tail that ends nothing else has a rate with a
    gamma prior whose mean follows its places inside lines (endings never seen have the share of those seen once inside
    texts, where nothing is cut).  Cuts at random places are taken off the ends of texts.
    """
    total = counts.groupBy("tail").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    once = F.sum(F.when((F.col("inside") == 1) & (sum(F.col(c) for c in _COUNTS) == 1), 1)).alias("once")
    sums = total.agg(once, *[F.sum(c).alias(c) for c in _COUNTS], *[F.sum(F.when(F.col(c) == 1, 1)).alias(f"once_{c}") for c in _COUNTS[:-1]]).first()
    words, places = max(1, sums.inside or 0), max(1, chars)
    at = F.col("inside") + F.col("longer")
    # never seen elsewhere: as often as words that stand once are met, at any of their letters
    unseen = max(1.0, 6.0 * (sums.once or 0)) / places
    out = [F.col("tail")]
    for k in range(len(KINDS)):
        name = f"e{k}" if k < 3 and sums[f"e{k}"] else f"f{k}"
        ends = max(1, (sums[f"e{k}"] or 0 if k < 3 else 0) + (sums[f"f{k}"] or 0))
        new = max(1, sums[f"once_{name}"] or 0) / max(1, sums[name] or 0)
        mean = new * ends * (F.col("inside") + 0.01) / words
        inside = F.col(f"e{k}") if k < 3 else F.lit(0)
        seen = inside + F.greatest(F.lit(0.0), F.col(f"f{k}") - 1 - cut_rate * at)
        whole = (F.greatest(F.lit(0.0), seen - DISCOUNT) + SHAPE / (1 + SHAPE / mean)) / ends
        out.append(F.when(at + inside + F.col(f"f{k}") > 1, F.log(F.greatest(at.cast("double"), F.lit(0.05)) / places / whole)).otherwise(F.lit(math.log(unseen / new))).alias(f"r{k}"))
    return longer_words(counts).select(*out)


def _normal_pdf(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def fit_censored(free: list[tuple[float, int]], censored: list[tuple[float, int]], rounds: int = 60) -> tuple[float, float]:
    """Mean and deviation of the logarithm, by EM over right-censored counts: (log length, count) each."""
    n = sum(c for _, c in free) + sum(c for _, c in censored)
    if not n or not sum(c for _, c in free):
        return 0.0, 1.0
    nf = sum(c for _, c in free)
    mu = sum(x * c for x, c in free) / nf
    sd = max(0.05, math.sqrt(sum((x - mu) ** 2 * c for x, c in free) / nf))
    for _ in range(rounds):
        s1, s2 = sum(x * c for x, c in free), sum(x * x * c for x, c in free)
        for at, c in censored:
            z = (at - mu) / sd
            h = _normal_pdf(z) / max(1e-12, _normal_tail(z))
            m = mu + sd * h
            v = sd * sd * max(1e-6, 1 + z * h - h * h)
            s1 += c * m
            s2 += c * (v + m * m)
        mu, sd = s1 / n, max(0.05, math.sqrt(max(1e-9, s2 / n - (s1 / n) ** 2)))
    return mu, sd


#: Width of a bin of the logarithm of a length.
_BIN = 0.02


def limits(measures: DataFrame) -> dict[tuple[str, str], dict[int, float]]:
    """(source, measure) -> {limit: share of the values there that were cut}, of rows (source, measure, n) of distinct values.

    Sums per source and bin of lengths, and the spikes, are all that reaches the driver.
    """
    per = measures.filter("n > 0").groupBy("source", "measure", "n").agg(F.count("*").alias("c")).persist()
    try:
        order = Window.partitionBy("source", "measure").orderBy("n")
        around = (F.sum("c").over(order.rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)) - F.col("c")) / (2 * SPIKE_AROUND)
        level = F.greatest(around, F.lit(0.5 / SPIKE_AROUND))
        spikes = per.withColumn("level", level).filter((F.col("c") > F.col("level")) & (2 * (F.col("c") * F.log(F.col("c") / F.col("level")) - F.col("c") + F.col("level")) >= SPIKE_TEST)).collect()
        bins = per.groupBy("source", "measure", F.floor(F.log("n") / _BIN).alias("b")).agg(F.sum("c").alias("c")).collect()
    finally:
        per.unpersist()
    by: dict[tuple[str, str], list] = {}
    for r in bins:
        by.setdefault((r.source, r.measure), []).append((r.b, r.c))
    out: dict[tuple[str, str], dict[int, float]] = {}
    for key in sorted({(r.source, r.measure) for r in spikes}):
        mine = [r for r in spikes if (r.source, r.measure) == key]
        at: Counter = Counter()
        for r in mine:
            at[math.floor(math.log(r.n) / _BIN)] += r.c
        free = [((b + 0.5) * _BIN, max(0, c - at.get(b, 0))) for b, c in by[key]]
        mu, sd = fit_censored(free, [(math.log(r.n), r.c) for r in mine])
        total = sum(c for _, c in by[key])
        for r in mine:
            expected = total * _normal_pdf((math.log(r.n) - mu) / sd) / (sd * r.n)
            out.setdefault(key, {})[r.n] = max(0.0, 1 - expected / r.c)
    return out


def shares(counts: list[tuple], priors: dict[tuple, float], rounds: int = 40) -> tuple[dict, dict, dict]:
    """EM over counts (source, place, class, log ratio, n): the share of cut values by (source, place), P(class | whole) by
    (source, class), P(class | cut) by (kind of place, class): limits in characters, in tokens, and none.

    ``priors``: the censored share at the places that are limits, worth PRIOR values; elsewhere the share is free.
    """
    groups = sorted({(c[0], c[1]) for c in counts})
    sources = sorted({c[0] for c in counts})
    g = np.array([groups.index((c[0], c[1])) for c in counts])
    s = np.array([sources.index(c[0]) for c in counts])
    k = np.array([CLASSES.index(c[2]) for c in counts])
    ratio, n = np.exp(np.clip([c[3] for c in counts], -30, 30)), np.array([c[4] for c in counts], dtype=np.float64)
    prior = np.array([priors.get(x, 0.02) for x in groups])
    weight = np.array([PRIOR if x in priors else 1.0 for x in groups])
    kinds = sorted({x[1][:1] for x in groups})
    kind = np.array([kinds.index(x[1][:1]) for x in groups])[g]
    chance = np.array([BY_CHANCE[x] for x in kinds])
    first_cut, first_whole = np.array([0.5, 0.0, 0.15, 0.15, 0.07, 0.1]), np.array([0, 0.8, 0.05, 0.05, 0.05, 0.05])
    cut, cut_class = prior.clip(1e-4, 0.999), np.tile(first_cut, (len(kinds), 1))
    cut_class[:, 1] = chance
    whole = np.tile(first_whole, (len(sources), 1))
    total = np.bincount(g, n, len(groups))
    for _ in range(rounds):
        whole[:, 0] = 1e-4  # a broken ending is none of a whole text, but for oddities
        a, b = cut[g] * cut_class[kind, k] * ratio, (1 - cut[g]) * whole[s, k]
        r = a / (a + b)
        cut = ((np.bincount(g, r * n, len(groups)) + weight * prior) / (total + weight)).clip(1e-5, 0.999)
        c, w = np.tile(first_cut, (len(kinds), 1)), 0.1 * np.tile(first_whole, (len(sources), 1))
        np.add.at(c, (kind, k), r * n)
        np.add.at(w, (s, k), (1 - r) * n)
        c[:, 1] = 0
        cut_class = (1 - chance[:, None]) * c / c.sum(1, keepdims=True)
        cut_class[:, 1] = chance
        whole = np.maximum(w / w.sum(1, keepdims=True), 1e-5)
    whole[:, 0] = 1e-4
    at = lambda m, names: {(x, c): m[i, j] for i, x in enumerate(names) for j, c in enumerate(CLASSES)}
    return dict(zip(groups, cut.tolist())), at(whole, sources), at(cut_class, kinds)


#: Chance that a value's recorded tokens are of the text before it was cut, and the width of their log ratio then.
KEPT_TOKENS, KEPT_WIDTH = 0.5, 2.5


def judged(features: DataFrame, counts: DataFrame, hints: Column | None = None) -> DataFrame:
    """The features with ``cut``, the posterior that the value was cut (null without a text of its own).

    ``features`` has source, h (a hash of the text), tokens and the columns of EVIDENCE; ``hints`` is further evidence, a log
    ratio.
    """
    stages = Stages(features.sparkSession, "cut")
    spark = features.sparkSession
    own = features.filter("own")
    texts = own.groupBy("source", "h").agg(F.max("chars").alias("chars"), F.max("tokens").alias("tokens"), F.max("own_tokens").alias("own_tokens"), F.max("how").alias("how"))
    measure = F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("n")), F.struct(F.lit("tokens").alias("measure"), F.col("tokens").alias("n")))).alias("m")
    found = limits(texts.select("source", measure).select("source", "m.*"))
    # the ratio of recorded to own tokens of whole texts: median and deviation from the middle two thirds
    log_ratio = F.log(F.col("tokens") / F.greatest(F.lit(1.0), "own_tokens"))
    middle = texts.filter("how = 'natural' AND tokens > 0").groupBy("source").agg(F.percentile_approx(log_ratio, F.array(*map(F.lit, (0.16, 0.5, 0.84))), 2000).alias("middle"))
    counted = {"cut": F.col("how") == CUT, "whole": F.col("how") == NATURAL, "cut_blank": (F.col("how") == CUT) & F.col("blank"), "whole_blank": (F.col("how") == NATURAL) & F.col("blank")}
    totals = own.agg(F.sum("chars").alias("chars"), F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in counted.items()]).first()
    ratios = tail_ratios(counts, totals.chars or 0, 2 * (totals.cut or 0) / max(1, totals.chars or 0))
    places = spark.createDataFrame([(s, m, n) for (s, m), at in found.items() for n in at], "source string, measure string, n bigint")
    in_chars = F.broadcast(places.filter("measure = 'chars'").select("source", F.col("n").alias("chars"), F.concat(F.lit("c"), F.col("n").cast("string")).alias("limit_c")))
    in_tokens = F.broadcast(places.filter("measure = 'tokens'").select("source", F.col("n").alias("tokens"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("limit_t")))
    spread = F.greatest(F.lit(0.04), (F.col("middle")[2] - F.col("middle")[0]) / 2)
    # own tokens are rounded up, so short texts tell less
    wide = F.sqrt(spread * spread + F.pow(1 / F.greatest(F.lit(1.0), "own_tokens"), 2))
    z = (log_ratio - F.col("middle")[1]) / wide
    usual = F.exp(-z * z / 2) / (wide * math.sqrt(2 * math.pi))
    kept = F.when(z > 0, F.lit(1 / KEPT_WIDTH)).otherwise(0.0)
    lost = F.log(((1 - KEPT_TOKENS) * usual + KEPT_TOKENS * kept + 1e-6) / (usual + 1e-6))
    by_tokens = F.when(F.col("limit_t").isNull() & (F.col("tokens") > 0) & F.col("middle").isNotNull(), lost).otherwise(0.0)
    # a blank left at the end: as often as broken endings have one, against whole ones
    share = lambda n, of: ((n or 0) + 0.5) / ((of or 0) + 1)
    b, w = share(totals.cut_blank, totals.cut), share(totals.whole_blank, totals.whole)
    left = F.when(F.col("how") != OPEN_TAIL, 0.0).when(F.col("blank"), math.log(b / w)).otherwise(math.log((1 - b) / (1 - w)))
    tail = F.element_at(F.array("r0", "r1", "r2", "r3"), F.col("kind") + 1)
    name = F.when(F.col("how") == OPEN_TAIL, F.concat(F.lit("open"), F.col("kind").cast("string"))).otherwise(F.col("how"))
    rows = (
        features.join(in_chars, ["source", "chars"], "left").join(in_tokens, ["source", "tokens"], "left").join(middle, "source", "left").join(ratios, "tail", "left")
        .withColumn("place", F.coalesce("limit_c", "limit_t", F.lit("")))
        .withColumn("class", name)
        .withColumn("ratio", F.when(F.col("own"), F.round(F.coalesce(tail, F.lit(0.0)) + by_tokens + left + (hints if hints is not None else F.lit(0.0)), 1)))
        .select(*features.columns, "place", "class", "ratio")
    )
    rows = stages.cut(rows)
    table = [tuple(r) for r in rows.filter("own").groupBy("source", "place", "class", "ratio").agg(F.count("*").alias("n")).collect()]
    priors = {(s, f"{m[0]}{n}"): p for (s, m), at in found.items() for n, p in at.items()}
    cut, whole, cut_class = shares(table, priors) if table else ({}, {}, {})
    odds = [(s, p, c, math.log(w * cut_class[p[:1], c] / ((1 - w) * whole[s, c]))) for (s, p), w in cut.items() for c in CLASSES]
    prior = spark.createDataFrame(odds, "source string, place string, class string, odds double")
    return rows.join(prior, ["source", "place", "class"], "left").withColumn("cut", F.when(F.col("own"), 1 / (1 + F.exp(-(F.col("odds") + F.col("ratio")))))).drop("place", "class", "ratio", "odds")


def cut_calls(calls: DataFrame, holds_text: Callable[[str | None, str | None], bool]) -> DataFrame:
    """(trace_id, stage, cut) of every call: whether its response stops before its end.  ``holds_text(response, error)`` tells answers from placeholders."""
    cols = calls.select(
        clean_id("trace_id").alias("trace_id"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.coalesce("stage", F.lit("unknown")).alias("source"), F.xxhash64(F.rtrim("response_text")).alias("h"),
        F.col("completion_tokens").cast("bigint").alias("tokens"), "response_text", "error",
    ).filter("trace_id IS NOT NULL")
    features, counts = scan(cols, "trace_id string, ingested_at timestamp, source string, h bigint, tokens bigint", 5, 5, lambda r, e: evidence(r, holds_text(r, e)), EVIDENCE)
    last = judged(features, counts).groupBy("trace_id").agg(F.max_by(F.struct("source", "cut"), F.struct("ingested_at", "h")).alias("r"))
    return last.select("trace_id", F.col("r.source").alias("stage"), F.coalesce(F.col("r.cut") > 0.5, F.lit(False)).alias("cut"))
