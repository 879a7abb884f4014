import pytest

from corpusloom.functions import structure as S
from corpusloom.operators.claims import Knob, consolidate


def test_sections_and_promotion():
    t = "# A\nx\n## B\ny\n# C\n"
    assert [(a, t[a:b]) for a, b, *_ in S.heading_spans(t)] == [(0, "# A\nx\n## B\ny\n"), (6, "## B\ny\n"), (13, "# C\n")]
    text, n = S.promote_headings("CHAPTER I\ntext\n\nRISK FACTORS\n\nCONTENTS\n\n```\nCHAPTER II\n```\n第三章 x\n")
    assert n == 3 and "## RISK FACTORS" in text and "\nCHAPTER II\n" in text
    assert S.promote_headings("# a\n# b\n# c\nCHAPTER I\n")[1] == 0


def test_tables_glossary_highlights():
    t = "| n | text |\n|---|---|\n| 1 | The in- |\n| 2 | dex keeps |\n| 3 | it. |\n"
    data = "| 9 | a |\n|---|---|\n| 1 | b |\n| 8 | c |\n| 2 | d |\n"
    assert S.flatten_numbered_tables(t.replace("| n | text |\n|---|---|\n", "")) == ("The index keeps it.\n", 1)
    assert S.flatten_numbered_tables(data) == (data, 0)
    body, rows = S.take_glossary("x\n## Glossary\n\n| a | b |\n|---|---|\n| t | u |\ny")
    assert body == "x\ny" and rows == [["t", "u"]]
    once, n = S.highlight("---\ntitle: span\n---\na span here", ["span", "absent", "x"])
    assert n == 1 and once.endswith("a ==span== here") and S.highlight(once, ["span"]) == (once, 0)


def test_consolidation(spark):
    rows = [("c", "i1", ["z"]), ("c", "i1", ["z"]), ("c", "i2", ["c"]), ("c", "i3", None)] + [("d", f"i{k}", []) for k in range(9)]
    got = {r.claim_id: tuple(r)[1:] for r in consolidate(spark.createDataFrame(rows, "claim_id string, insight string, grounded_on array<string>")).collect()}
    assert got["c"] == (pytest.approx(0.7), 3, 1, 1) and got["d"][0] == pytest.approx(0.9)


def test_knob():
    k = Knob(10, 5, 20, (0.2, 0.4), 0.8)
    assert k.move(10, None, 9) == ("insufficient", 10) and k.move(10, 0.9, 9, before=8) == ("rollback", 8)
    assert k.move(10, 0.5, 9) == ("down", 8.0) and k.move(10, 0.1, 9) == ("up", 12.0) and k.move(10, 0.3, 9) == ("hold", 10)
    assert k.move(5, 0.5, 9) == ("hold", 5) and k.move(10, 0.5, 9, due=False) == ("cooldown", 10)


def test_lenient_json_tries_every_bracket_and_repairs_escapes_in_one_pass():
    from corpusloom.functions.extract import lenient_json

    assert lenient_json('x [note] then {"a": 1}') == {"a": 1}
    assert lenient_json(r'{"a": "\\D and \q"}') == {"a": r"\D and \q"}
    assert lenient_json(r'{"a": "\frac \Delta"}') == {"a": r"\frac \Delta"}
    assert lenient_json('[{"a": 1}, {"b') == [{"a": 1}] and lenient_json("none [here]") is None


def test_division_headings():
    from corpusloom.functions.structure import all_capitals, names_division

    assert all(map(names_division, ("CHAPTER IV", "PART 2: on", "第十二章 家"))) and not any(map(names_division, ("CHAPTER", "PART of it", "第章", "Chapter 1", "")))
    assert all_capitals("THE OLD HOUSE") and not all_capitals("THE") and not all_capitals("The Old")
