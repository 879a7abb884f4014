from datetime import datetime, timedelta

import pytest

from corpusloom.llm import pairs as P
from corpusloom.llm import truncation as T
from corpusloom.llm.language import language

EN = "Summarise the passage below in a few sentences.\n\nThe vault index keeps the reading list. The nightly run drops the margin notes of the page."


@pytest.mark.parametrize("r", [None, "", " \n", "...", "—", "N/A", "**Answer:**", "```\n```", "<answer></answer>", "{}", "null", "Error: connection reset by peer", "[llm error] request timed out after 60 s", "context length exceeded"])
def test_empty(r):
    assert P.features(EN, r, None)[0] == "empty"


def test_own_error_is_empty_and_short_answers_are_not():
    assert P.features(EN, "Quota gone", "quota gone")[0] == "empty"
    for r in ("[]", "7", "supported", "No errors were found in the passage."):
        assert P.features(EN, r, "x")[0] != "empty"


@pytest.mark.parametrize(
    "r",
    ["I'm sorry, but I can't help with this. Please try a different question.", "Thank you for sharing the passage. I have to decline.", "Es tut mir leid, diese Anfrage muss ich ablehnen.", "Je dois décliner cette requête. Posez-moi une autre question.", "Lo siento, no puedo ayudar con esta petición.", "申し訳ありませんが、このご依頼にはお応えできません。別の質問をお試しください。", "抱歉，我无法协助处理这个请求。"],
)
def test_refusal(r):
    assert P.features(EN, r, None)[0] == "refusal"


@pytest.mark.parametrize("r", ["The author declines to answer the critics. The rest is sound.", "I cannot say this often enough: the passage is mostly sound. It keeps the list.", "I won't repeat the passage; its core is this. The index keeps a list of notes."])
def test_no_refusal(r):
    assert P.features(EN, r, None)[0] is None


def test_copy():
    assert P.features(EN, EN, None)[0] == "copy"
    assert P.features(EN, "Question: " + EN.replace("\n\n", " ").lower(), None)[0] == "copy"
    assert P.features(EN, "Summarise the passage below in a few sentences.", None)[0] == "copy"
    passage = EN.split("\n\n")[1]
    assert P.features("Repeat the passage word for word.\n\n" + passage, passage, None)[0] is None
    fr = "Résume le passage suivant en quelques phrases.\n\nLe registre répète la longue citation de la page."
    assert P.features(fr, fr.split("\n")[0], None)[0] == "copy"
    assert P.features(EN, "In short, the index keeps a list and the run drops some notes.", None)[0] is None


def test_language():
    de = "Der Bericht prüft die Leseliste und das Register ordnet eine stille Annahme. Die Notiz ist nicht neu."
    assert P.features(EN, de, None)[0] == "language" and P.features(EN, "Sure, here it is. " + de, None)[0] == "language"
    assert P.features("Translate the passage into German.\n\nThe index keeps the list of the page.", de, None)[0] is None
    assert P.features("German answer please: what does this note say?\n\n索引保留了列表。", "The index keeps the list of the page and it is not new.", None)[0] == "language"
    assert P.features(EN, "```python\nfor der in die: das(der)\n```", None)[0] is None
    assert language("") == "" and language("12 34") == "" and language("索引保留了列表") == "zh" and language("索引は一覧を残した") == "ja"


@pytest.mark.parametrize(
    ("text", "how"),
    [
        ("All is said.", "natural"), ("All is sa", "tail"), ("One ends. Two is c", "cut"), ("It ends …", "cut"), ("It ends [truncated]", "cut"), ("caf�", "cut"), ("asked Dr.", "cut"), ("He said “yes. Then no.", "cut"), ("„Stimmt das?“, fragte er.", "natural"),
        ('[{"a": 1}]', "natural"), ('[{"a": 1}, {"b', "cut"), ("```json\n[1]\n```", "natural"), ("```python\nx = 1", "cut"), ("```\nx\n``` It runs.", "natural"), ("| a | b |\n|---|---|\n| 1 | 2 |", "natural"), ("| a | b |\n|---|---|\n| 1", "cut"), ("索引保留了列表。", "natural"), ("索引保留了。列表", "cut"),
    ],
)
def test_endings(text, how):
    assert T.ending(text) == how


SCHEMA = "trace_id string, stage string, prompt_text string, response_text string, completion_tokens bigint, status string, error string, ingested_at timestamp, defect string"
T0 = datetime(2025, 1, 1)


def calls(spark, rows):
    return spark.createDataFrame([(i, s, p, r, n, "succeeded", None, T0 + timedelta(hours=h), "x") for i, s, p, r, n, h in rows], SCHEMA)


def test_calls(spark):
    import random

    rnd = random.Random(2)
    words = "index keeps list notes page run drops margin vault reading quiet early".split()
    sentence = lambda: "The " + " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 9))) + ". "
    rows = []
    for i in range(300):
        text = "".join(sentence() for _ in range(rnd.randint(2, 9))).strip()
        rows.append((f"t{i}", "digest", EN, text[:240], len(text) // 4, 0))
    cut = {i for i, _, _, r, _, _ in rows if not r.endswith(".")}
    rows += [(" T0 ", "digest", EN, "later and whole.", 3, 5), ("e", None, EN, None, None, 0), ("f", "unknown", EN, "N/A", 1, 0), (None, "digest", EN, None, 1, 0), ("n", "digest", None, "The index keeps the list.", None, 0)]
    got = {r.trace_id: (r.stage, r.defect) for r in P.defects(calls(spark, rows)).collect()}
    assert len(got) == 303 and got["e"] == ("unknown", "empty") and got["f"] == ("unknown", "empty") and got["n"] == ("digest", None)
    assert {i for i, (_, d) in got.items() if d == "truncated"} >= cut - {"t0"} and got["t0"][1] is None
    assert sum(d == "truncated" for _, d in got.values()) <= len(cut) + 12
    assert P.defects(calls(spark, [])).count() == 0


def test_shortened_versions(spark):
    long = "The first sentence stands here. The second one follows it."
    rows = [("a", "s", EN, long, 1, 0), ("b", "s", EN, long[:40], 1, 0), ("c", "s", EN, "Something else altogether.", 1, 0), ("d", "s", EN, long, 1, 0)]
    texts = {r.text for r in P._edges(P.shortened(calls(spark, rows))).collect()}
    assert texts == {long[:40]}


def test_beginnings_decide(spark):
    """Inside a word of a longer version, and beside a longer answer to the same prompt; a whole answer to another prompt stays."""
    word, whole = "- the old list of early notes", "The index keeps the list of notes. The run drops the page."
    rows = [(f"l{i}", "s", EN, f"- item {chr(97 + i)} of the early notes\n- the early notes", None, 0) for i in range(20)]
    rows += [("a", "s", "Prompt one.", word, None, 0), ("b", "s", "Prompt two.", word + "hop and of more.", None, 0)]
    rows += [("c", "s", "Prompt three.", whole[:34], None, 0), ("d", "s", "Prompt three.", whole, None, 0), ("e", "s", "Prompt four.", whole[:34], None, 0), ("g", "s", None, whole[:34], None, 0)]
    got = {r.trace_id: r.defect for r in P.defects(calls(spark, rows)).collect()}
    assert {i for i, d in got.items() if d == "truncated"} == {"a", "c"}


def test_long_errors_and_refusals():
    frames = "".join(f'  File "/srv/app/worker_{i}.py", line {i}, in call\n    reply = send(request)\n' for i in range(12))
    for r in (f"Traceback (most recent call last):\n{frames}TimeoutError: no reply", "Error: the upstream gave no reply. " + "It was asked again and again. " * 12, "java.io.IOException: closed\n" + "\tat org.example.Call.run(Call.java:7)\n" * 20):
        assert len(r) > 300 and P.features(EN, r, None)[0] == "empty"
    own = "The quota of this account is used up for now. " * 10
    assert P.features(EN, own, own.upper())[0] == "empty" and P.features(EN, own, "x")[0] != "empty"
    assert P.features(EN, "I'm sorry, but I can't help with this. Please try a different question. " * 12, None)[0] == "refusal"
    for r in ("Error: the passage has one.\nThe index keeps the list of notes, which the run drops from the page. " * 6, "Error bars are given in the passage. " * 12):
        assert P.features(EN, r, None)[0] != "empty"
