from corpusloom.llm import boilerplate as B

SITE = "quiet-atlas.example"
PAGE = """Home · About · Log in
You are here: Home / Essays / The reading li
We use cookies to make this site work. Accept all Manage preferen
Related reading
Another title of ours
A single teaser sentence ends here.
03.06.2024
The reading list
Privacy is where the note begins. It ends somewhere else, as the page shows.
Subscribe for 3.50 a month and read without limits.
- The first item
1) The second item
A row of the table | 4 | 75.5
## A subhead of the text
Home was a word that nobody used. The text runs on for another sentence.
12 comments
Tags
More titles to read
© 2024 quiet-atlas.example. All rights reserved."""
BODY = {7, 8, 10, 11, 12, 13, 14}


#: What the pages of a corpus would tell: nothing of this is fixed in the library.
KNOWN = frozenset(
    B._key("en", B._masked(x, SITE))
    for x in "home|about|log in|you are here: home|essays|we use cookies to make this site work.|accept all|manage preferences|related reading|subscribe for 3.50 a month and read without limits.|12 comments|tags|all rights reserved.|share".split("|")
)


def found(content, snippet=None, title="The reading list", common=KNOWN):
    rows = B.furniture(1, SITE, title, snippet, content, common)
    return {k for _, f, k in rows if f == "content"}, {k for _, f, k in rows if f == "snippet"}


def test_page():
    got, _ = found(PAGE)
    assert got == set(range(19)) - BODY


def test_markup_and_blank_lines():
    page = "\n\n".join(f'<li><a href="/p1">{x}</a></li>' if k not in BODY else f"<p>{x}</p>" for k, x in enumerate(PAGE.split("\n")))
    assert found(page)[0] == {2 * k for k in set(range(19)) - BODY}


def test_without_title_line_and_title():
    lines = PAGE.split("\n")
    del lines[7]
    body = {k - 1 if k > 7 else k for k in BODY - {7}}
    assert found("\n".join(lines), "Home · About\nPrivacy is where the note begins. It", None) == (set(range(18)) - body, {0})


def test_common_phrases_count_as_furniture():
    page = "Unheard of notice here\n" + PAGE
    key = B._key("en", "unheard of notice here")
    assert 0 in found(page, common=KNOWN | {key})[0]


def test_odd_fields():
    assert found(None) == (set(), set()) and found("") == (set(), set()) and found(" \n ") == (set(), set())
    assert found("Log in\nShare")[0] == {0, 1} and found("Just text.", "", None) == (set(), set())
    assert found("x " * 100_000)[0] == set()


def test_dataframe(spark):
    schema = "item_id bigint, site string, title string, snippet string, content string, field string"
    rows = [(1, SITE, "The reading list", "About\nText.", PAGE, "x")] * 2 + [(2, None, None, None, None, "x"), (3, SITE, None, "Home", "", None)]
    # other pages of the site, from which its furniture is learnt
    other = lambda i: "\n".join(f"{x} {'ab'[i % 2] * (i + 3)}" if k in BODY else f"Title {i * k} {'cd'[i % 2] * i}" if k in (4, 5, 17) else x for k, x in enumerate(PAGE.split("\n")))
    rows += [(10 + i, SITE, f"The reading list {'ab'[i % 2] * (i + 3)}", "Share\nText.", other(i), "x") for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in B.furniture_lines(df).collect()]
    assert len(got) == len(set(got)) and {k for i, f, k in got if (i, f) == (1, "content")} == set(range(19)) - BODY
    assert {(i, k) for i, f, k in got if f == "snippet" and i < 10} == {(1, 0), (3, 0)}
    bodies = {r.item_id: (r.content, r.snippet) for r in B.main_bodies(df).collect()}
    assert bodies[1][0].split("\n")[0] == "The reading list" and bodies[1][1] == "Text." and bodies[2] == (None, None)
    assert B.furniture_lines(df.limit(0)).count() == 0


def test_document_frequencies_over_all_pages(spark):
    pages = [(i, f"Strange notice of the house\nThe story of {'ab'[i % 2] * (i + 3)} is told in this line. It has two sentences, as the others.") for i in range(40)]
    df = spark.createDataFrame([(i, SITE, None, None, c) for i, c in pages], "item_id bigint, site string, title string, snippet string, content string").repartition(5)
    assert {(r.item_id, r.line_no) for r in B.furniture_lines(df).collect()} == {(i, 0) for i in range(40)}


def test_long_notices_are_learnt(spark):
    notice = "Our house keeps a small jar of crumbs on your machine so that the pages remember which of the many doors you came in by last time."
    menu = " | ".join([notice, "Strange door", "Odd window of the old house by the river and the sea"])
    pages = [(i, f"{notice}\n{menu}\nThe story of {'ab'[i % 2] * (i + 3)} is told in this line. It has two sentences, as the others.") for i in range(40)]
    assert len(notice) > 90 and B._masked(notice, "") in B.phrases(menu, "") and len(B.phrases("x / " * 200 + "y", "")) > 1
    df = spark.createDataFrame([(i, f"s{i}.example", None, None, c) for i, c in pages], "item_id bigint, site string, title string, snippet string, content string").repartition(5)
    assert {(r.item_id, r.line_no) for r in B.furniture_lines(df).collect()} == {(i, k) for i in range(40) for k in (0, 1)}


def test_furniture_of_a_small_site(spark):
    """A site of five articles has its own furniture; a page crawled thrice and a site of one page have none to learn from."""
    story = lambda i: f"The story of {'ab'[i % 2] * (i + 3)} is told in this line. It has two sentences, as the others."
    page = lambda i: f"Strange door of our house\n{story(i)}\n{story(i + 50)}"
    rows = [(i, "small.example", f"Title {i}", "Strange door of our house\n" + story(i), page(i)) for i in range(5)]
    rows += [(10 + i, "twice.example", "One title", None, page(7)) for i in range(3)] + [(20, "other.example", "Another title", None, page(9))]
    rows += [(100 + i, f"s{i}.example", f"Other {i}", None, story(i)) for i in range(400)]
    schema = "item_id bigint, site string, title string, snippet string, content string"
    got = {tuple(r) for r in B.furniture_lines(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert got == {(i, f, 0) for i in range(5) for f in ("content", "snippet")}
    assert {r.site: len(r["keys"]) for r in B.site_phrases(B.held_phrases(spark.createDataFrame(rows, schema))).collect()} == {"small.example": 1}


def test_short_line_blocks_go_without_a_lexicon():
    """Menus before and after an article in unheard-of words are told by the page's own distribution."""
    menu = ["Odd door", "Wide window", "Terms of use", "Privacy notice", "Low cellar", "Red attic"]
    story = [f"The story number {i} runs on through many a long line, and nobody minds. It has three sentences, as the others have. They are of the usual length of a paragraph in prose." for i in range(6)]
    page = menu + story[:3] + ["## A subhead", "- one item", "- another item"] + story[3:] + ["So it ends."] + menu
    assert found("\n".join(page), None, None, frozenset())[0] == {*range(5), *range(16, 22)}
    assert found("\n".join(page), None, "Unseen title", frozenset())[0] == {*range(6), *range(16, 22)}


def test_joined_phrases():
    judge = B._Judge(SITE, "", "en", KNOWN)
    assert judge.joined("Accept all We use cookies to make this site work. Manage preferences") and judge.joined("Log in Home Acc")
    assert not judge.joined("Home was a word that nobody used.") and not judge.joined("Nothing is known of this line")


def test_wilson_bound(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(B.lower_bound(F.lit(3.0), F.lit(15.0)), B.lower_bound(F.lit(60.0), F.lit(1000.0))).first()
    assert abs(got[0] - 0.0705) < 1e-3 and abs(got[1] - 0.0469) < 1e-3
