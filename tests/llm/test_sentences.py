import pytest

from corpusloom.llm.sentences import scan, sentence_units, units_of


def cut(text):
    return [text[a:b] for a, b in units_of(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dr. Who came. He left at 2 p.m. Then rain fell.", ["Dr. Who came.", "He left at 2 p.m.", "Then rain fell."]),
        ("See Fig. 9, i.e. the approx. 3.5 cases, etc. The rest is v2.7.1 of a.b.md.", ["See Fig. 9, i.e. the approx. 3.5 cases, etc.", "The rest is v2.7.1 of a.b.md."]),
        ("J. K. Rowe wrote. “Does it hold?” asked Ms. Poe. Really?! Yes ... but only once.", ["J. K. Rowe wrote.", "“Does it hold?” asked Ms. Poe.", "Really?!", "Yes ... but only once."]),
        ("He called it “a test.” The end (so it was.) is near.", ["He called it “a test.”", "The end (so it was.) is near."]),
        ("Der 1. Lauf begann am 7. März usw. „Stimmt das?“, fragte Fr. Adler z. B. ihn.", ["Der 1. Lauf begann am 7. März usw.", "„Stimmt das?“, fragte Fr. Adler z. B. ihn."]),
        ("« Est-ce sûr ? » demanda M. Roux. Voir p. ex. la fig. 7.", ["« Est-ce sûr ? » demanda M. Roux.", "Voir p. ex. la fig. 7."]),
        ("¿Por qué? ¡Así es! Sube a 3,5.", ["¿Por qué?", "¡Así es!", "Sube a 3,5."]),
        ("他问：「这成立吗？」她走了。“好。”他说。没有……不过还行！", ["他问：「这成立吗？」", "她走了。", "“好。”他说。", "没有……不过还行！"]),
        ("「止めて！」と書いた。博士は「本当か？」と尋ねた。", ["「止めて！」と書いた。", "博士は「本当か？」と尋ねた。"]),
        ("डॉ. राव आए। “क्या?” प्रो. ने पूछा। अंक 3.5 है।", ["डॉ. राव आए।", "“क्या?” प्रो. ने पूछा।", "अंक 3.5 है।"]),
        ("На рис. 2 видно, т. е. так. Ночь и т. д. Утро.", ["На рис. 2 видно, т. е. так.", "Ночь и т. д.", "Утро."]),
        ("لماذا؟ د. تلمر جاء. انتهى.", ["لماذا؟", "د. تلمر جاء.", "انتهى."]),
        ("งานเก็บ ระบบ vaultd ลบ คะแนน 3 ครั้ง", ["งานเก็บ", "ระบบ vaultd ลบ", "คะแนน 3 ครั้ง"]),
        ("One ends.Two begins. The K.B. index stays.", ["One ends.", "Two begins.", "The K.B. index stays."]),
        ("Line one\nwraps here. Next.\r\n\r\nNew block", ["Line one\nwraps here.", "Next.", "New block"]),
    ],
)
def test_sentences(text, want):
    assert cut(text) == want


def test_blocks():
    text = "---\ntitle: A. B.\n---\n# 2.6 The head ##\n- [x] one. Two.\n1. three\n\n```\nNo. Code.\n```\n| a. | B. |\nEnd."
    units, heads, _ = scan(text)
    assert [text[a:b] for a, b in units] == ["2.6 The head", "one. Two.", "three", "End."]
    assert [(level, t) for _, level, t in heads] == [(1, "2.6 The head")]


@pytest.mark.parametrize("text", ["", " ", "\n\n", "---", "```", "...", "?!", "。", "#", "- ", "a" * 200_000, "A. " * 20_000])
def test_odd_texts(text):
    units = units_of(text)
    assert all(a < b and text[a:b].strip() == text[a:b] for a, b in units) and units == sorted(units)


def test_dataframe(spark):
    rows = [(1, "It is. He did.", 9, 9), (2, None, 9, 9), (3, "", 9, 9), (4, "It is. He did.", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, unit_start int, unit_end int")
    got = sorted(map(tuple, sentence_units(df).collect()))
    assert got == [(1, 0, 6), (1, 7, 14), (4, 0, 6), (4, 7, 14)]
    assert sentence_units(df.limit(0)).count() == 0
