from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import decay, extract, markdown, text
from corpusloom.operators import joins, kernels, retrieval, stats, windows
from corpusloom.plans import workflow

T = datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bm25_floors_common_terms(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog bird"), (3, "dog fish"), (4, ""), (5, None)], "doc_id int, text string")
    queries = spark.createDataFrame([(1, "cat dog"), (2, ""), (3, "whale")], "query_id int, query string")
    got = {(r.query_id, r.doc): r.score for r in retrieval.bm25(queries, docs, "doc_id", "text").collect()}
    n, avgdl = 5, 7 / 5
    raw = {t: np.log(n - df + 0.5) - np.log(df + 0.5) for t, df in (("cat", 1), ("dog", 3), ("bird", 1), ("fish", 1))}
    idf = {t: v if v >= 0 else 0.25 * np.mean(list(raw.values())) for t, v in raw.items()}
    score = lambda t, tf, dl: idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))
    assert got[(1, 1)] == pytest.approx(score("cat", 2, 3) + score("dog", 1, 3))
    assert set(got) == {(1, 1), (1, 2), (1, 3)}


def test_vector_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((120, 8))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 8), (502, [1.0])], "vec_id int, embedding array<float>")
    q = df.filter("vec_id % 40 = 0 AND vec_id < 120").select(F.col("vec_id").alias("query_id"), "embedding")
    f = np.vstack([v.astype(np.float32).astype(float), np.zeros(8)])
    names = [*range(120), 501]
    norms = np.linalg.norm(f, axis=1)
    for metric in ("cosine", "l2"):
        got = {}
        for r in retrieval.vector_search(q, df, 5, metric).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for i, ids in got.items():
            d = -(f @ f[i]) / np.where(norms > 0, norms, 1) if metric == "cosine" else ((f - f[i]) ** 2).sum(1)
            assert ids == [names[k] for k in np.argsort(d)[:5]]


def test_rrf_is_symmetric_and_cap_keeps_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, id int, rank int")
    assert rows(retrieval.rrf([a, b], "id")) == rows(retrieval.rrf([b, a], "id"))
    best = retrieval.rrf([a, b], "id").orderBy(F.desc("score")).first()
    assert best.id == 11 and best.score == pytest.approx(1 / 62 + 1 / 61)
    ranked = spark.createDataFrame([(1, i, i % 2) for i in range(1, 9)], "query_id int, rank int, source int")
    assert [r.rank for r in retrieval.cap_per_key(ranked, "source").orderBy("rank").collect()] == [1, 2, 3, 4]


def test_mmr_prefers_what_differs():
    v = np.array([[1, 0], [1, 0.01], [0, 1]], dtype=float)
    assert retrieval.mmr_order(v, np.array([1.0, 0.99, 0.5]), 2) == [0, 2]
    assert retrieval.mmr_order(v, np.array([1.0, 1.0, 1.0]), 5)[:1] == [0]
    assert retrieval.mmr_order(np.zeros((0, 2)), np.zeros(0), 3) == []


def test_effective_dimension(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((50, 6)) * np.array([5, 3, 1, 1, 0.1, 0.1])
    df = spark.createDataFrame([(x.tolist(),) for x in v] + [([1.0],), (None,)], "embedding array<double>")
    c = v - v.mean(0)
    e = np.linalg.svd(c, compute_uv=False) ** 2
    assert stats.effective_dimension(df).first().eff_dim == pytest.approx(e.sum() ** 2 / (e**2).sum(), abs=1e-3)
    assert stats.effective_dimension(df.limit(0)).count() == 0


def test_streaks_trends_strikes(spark):
    s = spark.createDataFrame([("a", i, v) for i, v in enumerate("ggrrrg")], "k string, t int, v string")
    assert [r.streak for r in windows.streaks(s, "k", "t", "v").orderBy("t").collect()] == [1, 2, 1, 2, 3, 1]
    assert [r.arrow for r in windows.trend(s, "k", "t", "v", {"g": 0, "r": 1}).orderBy("t").collect()] == ["none", "same", "up", "same", "same", "down"]
    e = spark.createDataFrame([(1, T + timedelta(days=d), f) for d, f in ((0, True), (1, False), (2, True), (3, True), (4, True))] + [(2, T, True)], "k int, ts timestamp, failed boolean")
    assert {r.k: (r.fails, r.blocked) for r in windows.strikes(e, "k", "ts", "failed").collect()} == {1: (3, True), 2: (1, False)}
    n = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((5, 6, 4, 3, 2))], "k int, t int, n double")
    assert windows.tail_drops(n, "k", "t", "n").first().drops == 3
    d = spark.createDataFrame([(1, T), (1, T + timedelta(hours=3)), (1, T + timedelta(days=1)), (1, T + timedelta(days=5))], "k int, ts timestamp")
    assert [r.streak for r in windows.day_streaks(d, "k", "ts").orderBy("day").collect()] == [1, 2, 1]


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 10, 2), ("b", 1, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 2, "w")], "k string, pos int, v string")
    got = {r.id: r.h for r in joins.as_of(left, right, "k", "at", "pos", F.col("v"), "h").collect()}
    assert got == {1: "w", 2: "x", 3: None}


def test_overlaps_against_pairs(spark):
    rng = np.random.default_rng(3)
    spans = lambda n: [(int(k), int(s), int(s + w), int(i)) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 300, n), rng.integers(1, 90, n)))]
    a, b = spans(40), spans(40)
    schema = "k int, start int, end int, id int"
    got = sorted((r.a_id, r.b_id) for r in joins.overlaps(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k", 32).collect())
    assert got == sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])


def test_titles_edges_changes(spark):
    asked = spark.createDataFrame([("A  b",), ("C",), ("D",)], "title string")
    known = spark.createDataFrame([("a b (Stitched)",), ("a b (Synthesis)",), ("c",), ("c (Stitched)",)], "title string")
    assert rows(joins.best_title(asked, known)) == [("A  b", "a b (Stitched)", 95), ("C", "c", 100)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), (None, "a")], "src string, dst string")
    assert rows(joins.symmetric(e)) == [("a", "b"), ("b", "a")]
    now, then = spark.createDataFrame([(1, "x"), (2, "y")], "k int, h string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, h string")
    assert rows(joins.changed(now, then, "k", "h")) == [(1, "new"), (2, "changed"), (3, "removed")]
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "node string, parent string")
    assert joins.ancestors(links).groupBy("node").count().collect()[0]["count"] == 2


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(text.normalize_tags(F.array(*map(F.lit, ["#A B", "a__b", "--x--", "", "#"])))) == ["a-b", "x"]
    assert one(text.tokens(F.lit("Ab_1 é 中文x"))) == ["ab_1", "中", "文", "x"]
    assert one(text.canonical_url(F.lit(" HTTP://Ex.org?q=1#f "))) == "http://ex.org/?q=1"
    assert one(text.canonical_url(F.lit("https://u@ex.org/"))) == "" and one(text.canonical_url(F.lit("ftp://x/"))) == ""
    assert one(text.document_key(F.lit("X (Part 1)"))) == "X" and one(text.document_key(F.lit("Y(EN)"))) == "Y(EN)"
    assert one(text.section_refs(F.lit("see sec. 4.7 and §2, Section 4.7"))) == ["4.7", "2"]
    assert one(text.route_language(F.lit("a 中"))) == "zh" and one(text.route_language(F.lit("plain"))) == "en"


def test_decay(spark):
    at = lambda s, days: spark.range(1).select(decay.retrievability(F.lit(s), F.lit(T), F.lit(T + timedelta(days=days))).alias("r")).first().r
    assert at(0.0, 21) == pytest.approx(0.5) and at(0.0, -5) == 1.0
    s = spark.createDataFrame([("active", 0.5), ("active", 0.49), ("active", 0.19), ("fading", 0.61), ("fading", 0.2), ("dormant", 0.3), ("dormant", 0.31), ("falsified", 1.0)], "s string, r double")
    assert [r.n for r in s.select(decay.next_status(F.col("s"), F.col("r")).alias("n")).collect()] == ["active", "fading", "dormant", "active", "fading", "dormant", "fading", "falsified"]
    e = spark.createDataFrame([("k", T), ("k", T + timedelta(days=10))], "k string, ts timestamp")
    got = kernels.decay_grid(e, "k", "ts", [10.0], [2.0]).first()
    assert got.strength == pytest.approx(0.5)


TEXT = "---\ntitle: A\n---\n# One\n\nText. More text here.\n\n```\n# no heading\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n  y\n> q\n"


@pytest.mark.parametrize("t", [TEXT, "", "\n\n", "```\nopen", "$$\nx", "---\nnot closed", "a\r\nb\r\n", TEXT * 40])
def test_blocks_and_spans_cover(t):
    b = markdown.blocks(t)
    assert "".join(t[x.start : x.end] for x in b) == t
    tiles = markdown.structure_spans(t, 200, 400)
    assert "".join(t[a:e] for a, e, _ in tiles) == t and all(e - a <= 400 for a, e, _ in tiles)
    spans = markdown.fixed_spans(t, 300, 50)
    assert not t or spans[0][0] == 0 and spans[-1][1] == len(t) and all(x[0] < y[0] <= x[1] for x, y in zip(spans, spans[1:]))


def test_markdown_kernels():
    assert [b.kind for b in markdown.blocks(TEXT)] == ["frontmatter", "heading", "blank", "paragraph", "blank", "fence", "table", "blank", "list", "quote"]
    assert markdown.frontmatter(TEXT)[0] == {"title": "A"} and markdown.frontmatter("---\n: : :\n\t-\n---\nx")[0] == {}
    assert markdown.split_row(r"| a \| b | c |") == ["a | b", "c"] and not markdown.table_valid("| a |\n| b |\n| c |")
    fixed, repairs = markdown.clean("a​b  \n[[How\nfar]]\n```\nx")
    assert fixed.startswith("ab\n[[How far]]") and {n for n, _ in repairs} >= {"zero_width", "wikilink_newline", "open_fence"}
    assert markdown.strip_book_boilerplate("x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny") == "body"


def test_extraction():
    page = "<body><nav>menu</nav><article><h1>T</h1><p>Body <a href='/a'>a link</a></p></article><footer>f</footer></body>"
    assert extract.readable(page) == "T\nBody a link" and extract.links(page, "https://x.org/p") == [("https://x.org/a", "a link")]
    assert extract.lenient_json('Sure: ```json\n{"a": "\\alpha"}\n```') == {"a": "\\alpha"}
    assert extract.lenient_json('[{"a": 1}, {"b": 2}, {"c"') == [{"a": 1}, {"b": 2}] and extract.lenient_json("none") is None
    assert extract.snap_identifier("max-chars", ["max_chars", "min_chars"]) == "max_chars" and extract.snap_identifier("zzz", ["abc"]) is None
    assert extract.feed_items("<rss><channel><item><title>t</title><link>u</link></item></channel></rss>")[0]["url"] == "u"


def test_workflow():
    workflow.adapter("double")(lambda i: {"value": i["x"] * 2})
    steps = [workflow.Step("a", "double", {"x": "${start}"}), workflow.Step("b", "double", {"x": "${a.value}"}, {"equals": {"a.value": 4}}), workflow.Step("c", "double", {"x": 1}, {"missing": "a"})]
    env = workflow.run(steps, {"start": 2})
    assert env["b"] == {"value": 8} and env["c"] == {"skipped": True}
    with pytest.raises(RuntimeError, match="step a"):
        workflow.run([workflow.Step("a", "double", {"x": "${nowhere}"})], {})
