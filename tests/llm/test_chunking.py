import random

import pytest

from corpusloom.llm import chunking as C

random.seed(4)
WORDS = "the index keeps a list of notes and every page links to some other page in the vault".split()


def prose(n, seed=0):
    rnd = random.Random(seed)
    parts = []
    while sum(map(len, parts)) < n:
        s = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(4, 14))).capitalize() + ". "
        parts.append(s + ("\n\n" if rnd.random() < 0.15 else "") + (f"## Head {len(parts)}\n\n" if rnd.random() < 0.05 else ""))
    return "".join(parts)


@pytest.mark.parametrize("text", [prose(9000), "x" * 5000, "a b " * 900, "字" * 3000, "```\n" + "code line\n" * 500 + "```", ""])
def test_pieces_keep_the_contract(text):
    pieces = C.split(text, 600, 60)
    assert "".join(text[a:b] for a, b, *_ in pieces) == text
    as_rows = [{"chunk_index": k, "char_start": a, "char_end": b, "size": b - a, "section_path": p, "boundary_type": t, "overlap_chars": o} for k, (a, b, p, t, o) in enumerate(pieces)]
    assert C.faults(text, 600, 60, as_rows) == []


def test_edits_alter_neighbours_only():
    text = prose(40_000, 3)
    at = 20_000
    edited = text[:at] + "An inserted remark. " + text[at:]
    before = {text[a:b] for a, b, *_ in C.split(text, 1200, 0)}
    after = {edited[a:b] for a, b, *_ in C.split(edited, 1200, 0)}
    assert len(before - after) <= 6


@pytest.mark.parametrize(("field", "value"), [("size", 7), ("char_end", 610), ("char_start", 3), ("overlap_chars", 5), ("section_path", ["no"]), ("boundary_type", "h2"), ("boundary_type", None)])
def test_faults_are_found(field, value):
    text = prose(3000, 1)
    rows = [{"chunk_index": k, "char_start": a, "char_end": b, "size": b - a, "section_path": p, "boundary_type": t, "overlap_chars": o} for k, (a, b, p, t, o) in enumerate(C.split(text, 600, 60))]
    rows[2][field] = value
    assert 2 in C.faults(text, 600, 60, rows)


def test_dataframes(spark):
    text = prose(2000, 2)
    docs = spark.createDataFrame([(1, text, "p", "x"), (2, None, "p", "x"), (3, "short.", None, "x"), (4, "", "p", "x")], "doc_id bigint, text string, profile string, size string")
    profiles = spark.createDataFrame([("p", 600, 60), (None, 1, 1)], "profile string, max_chars int, overlap_chars int")
    pieces = C.split_documents(docs, profiles)
    assert {r.doc_id for r in pieces.collect()} == {1, 3}
    assert C.piece_faults(pieces.unionByName(pieces), docs, profiles).count() == 0
    assert C.piece_faults(pieces.limit(0), docs, profiles).count() == 0
    lost = pieces.filter("chunk_index != 1")
    assert (1, 2) in {tuple(r) for r in C.piece_faults(lost, docs, profiles).collect()}
