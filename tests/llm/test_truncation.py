import math
import random
from datetime import datetime, timedelta

import pytest

from corpusloom.llm import truncation as T
from corpusloom.llm.pairs import holds_text

SCHEMA = "trace_id string, stage string, response_text string, completion_tokens bigint, error string, ingested_at timestamp, cut string, h string"
T0 = datetime(2025, 1, 1)
WORDS = "index keeps list notes page run drops margin vault reading quiet early hypothesis citation".split()


def sentences(rnd, n):
    return "".join("The " + " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(5, 9))) + ". " for _ in range(n)).strip()


def found(spark, rows):
    df = spark.createDataFrame([(i, s, r, n, None, T0 + timedelta(hours=h), "x", "y") for i, s, r, n, h in rows], SCHEMA)
    return {r.trace_id: (r.stage, r.cut) for r in T.cut_calls(df, holds_text).collect()}


@pytest.mark.parametrize(("text", "tail"), [("- one item of the list", (1, "the list")), ("a\nb, c d, e f g", (2, "f g")), ("Only words here", (3, "words here")), ("One. Two\nIt rose from 23.", (0, "from 0.")), ("索引保留了列表", (3, "了列表")), ("```\nx\n``` It ru", (0, "It ru"))])
def test_open_tails(text, tail):
    assert T.open_tail(text) == tail


def test_longer_words_against_brute_force(spark):
    rnd = random.Random(4)
    tails = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 2))) + " " + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))): rnd.randint(1, 9) for _ in range(120)}
    rows = [(t, 0, 0, 0, 1, 0, 0, 0, n) for t, n in tails.items()] + [(t, 0, 0, 0, 0, 0, 0, 0, 1) for t in tails]
    got = {r.tail: r.longer for r in T.longer_words(spark.createDataFrame(rows, T._TAILS)).collect()}
    assert got == {t: sum(n + 2 for o, n in tails.items() if o != t and o.startswith(t)) for t in tails}


def test_tail_counts_leave_broken_ends_out():
    t = T.Tails()
    t.add("- the old list\n- the new list", T.OPEN_TAIL)
    t.add("It rose to 4.5 and to 7. It fell. Then a bro", T.CUT)
    assert t.ends[1] == {"old list": 1} and t.final[1] == {"new list": 1} and t.ends[0] == {"to 0.": 1}
    assert "a bro" not in t.inner and t.inner["to 0.0"] == 1 and t.inner["^ It"] == 1
    rows = t.rows()
    assert rows.num_rows > 5 and len(t) == 0


def test_censored_fit_recovers_the_parameters():
    rnd = random.Random(1)
    values = [math.exp(rnd.gauss(5, 0.6)) for _ in range(20_000)]
    free = [(math.log(v), 1) for v in values if v < 200]
    mu, sd = T.fit_censored(free, [(math.log(200), sum(v >= 200 for v in values))])
    assert abs(mu - 5) < 0.05 and abs(sd - 0.6) < 0.05
    assert T.fit_censored([], [(5.0, 3)]) == (0.0, 1.0) and T.fit_censored([(5.0, 0)], []) == (0.0, 1.0)


def test_a_limit_is_found_whatever_lies_beyond_it(spark):
    rnd = random.Random(3)
    lengths = [min(300, int(math.exp(rnd.gauss(5.5, 0.7)))) for _ in range(2000)] + [rnd.randint(301, 900) for _ in range(100)]
    at = T.limits(spark.createDataFrame([("s", "chars", n) for n in lengths], "source string, measure string, n bigint"))
    assert list(at["s", "chars"]) == [300] and at["s", "chars"][300] > 0.9


def test_shares_weigh_lengths_and_endings():
    """At a limit with a censored prior an ending that tells nothing is cut, elsewhere it isn't; strong evidence decides anywhere."""
    counts = [("s", "c300", T.CUT, 0.0, 90), ("s", "c300", "open1", 0.0, 10), ("s", "", T.NATURAL, 0.0, 1000), ("s", "", "open1", -3.0, 200), ("s", "", T.CUT, 0.0, 20)]
    cut, whole, kinds = T.shares(counts, {("s", "c300"): 0.95})
    odds = lambda place, k: math.log(cut["s", place] * kinds[place[:1], k] / ((1 - cut["s", place]) * whole["s", k]))
    assert odds("c300", "open1") > 0 > odds("", "open1") and odds("", T.CUT) > 3 and odds("", T.NATURAL) < -4


def test_cut_values(spark):
    rnd = random.Random(2)
    rows = [(f"t{i}", "digest", (t := sentences(rnd, rnd.randint(2, 9)))[:240], len(t[:240]) // 4, 0) for i in range(300)]
    cut = {i for i, _, r, _, _ in rows if not r.endswith(".")}
    # cut in transfer at a full stop: only the tokens tell; a decimal point
    rows += [("tok", "digest", "The index keeps the list.", 300, 0)]
    rows += [(f"d{i}", "digest", f"The list rose from {i}.{i + 1} to {i + 2}.{i}. The index drops the page.", 15, 0) for i in range(10, 60)] + [("dec", "digest", "The index drops the page. The list rose from 23.", 12, 0)]
    rows += [(" T0 ", "digest", "later and whole.", 3, 5), ("e", None, None, None, 0), ("f", "unknown", "N/A", 1, 0), ("g", None, " ", 1, 0), (None, "digest", "x", 1, 0), ("n", "digest", "The index keeps the list.", None, 0)]
    got = found(spark, rows)
    assert got["e"] == got["f"] == got["g"] == ("unknown", False) and got["n"] == ("digest", False) and got["t0"] == ("digest", False) and len(got) == 356
    assert {i for i, (_, c) in got.items() if c} >= cut - {"t0"} | {"tok", "dec"}
    assert sum(c for _, c in got.values()) <= len(cut) + 15


def test_titles_and_empty_tables(spark):
    rnd = random.Random(5)
    rows = [(f"t{i}", "title", f"{rnd.choice(WORDS)} of {rnd.choice(WORDS)} {i % 7}", 5, 0) for i in range(200)]
    assert not any(c for _, c in found(spark, rows).values())
    assert found(spark, []) == {} and found(spark, [("a", "s", None, None, 0)]) == {"a": ("s", False)}
    long = "The index keeps the list of notes. " * 20_000
    assert found(spark, [("a", "s", long, None, 0), ("b", "s", long.strip() + " The ind", None, 0)])["b"][1]


def test_repeated_rows_count_once(spark):
    got = found(spark, [("a", "s", "One ends. Two is c", 5, 0)] * 3 + [("A ", "s", "One ends. Two is cold.", 5, 1)])
    assert got == {"a": ("s", False)}
