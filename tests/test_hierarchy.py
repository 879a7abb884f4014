import random
from datetime import datetime

from corpusloom.operators.hierarchy import Hierarchy, parent_links

LINK = "id string, parent string, ingested_at timestamp, node_kind int"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def brute(parents):
    """root and depth by walking up."""
    out = {}
    for n in parents:
        seen, at, depth = {n}, n, 0
        while parents.get(at) in parents:
            at = parents[at]
            depth += 1
            if at in seen:
                out[n] = ("", -1)
                break
            seen.add(at)
        else:
            out[n] = (at, depth)
    return out


def forest(seed, n):
    rnd = random.Random(seed)
    parents = {}
    for i in range(n):
        kind = rnd.random()
        parents[f"n{i}"] = None if kind < 0.05 else "gone" if kind < 0.08 else f"n{i - 1}" if kind < 0.6 and i else f"n{rnd.randrange(i + 1)}"
    parents["n3"] = "n9"  # most likely a cycle
    parents |= {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c3", "c5": "c4", "self": "self"}
    return parents


def build(spark, parents):
    rows = [(k, v) for k, v in parents.items()]
    return Hierarchy(spark.createDataFrame(rows, "node string, parent string"))


def test_roots_and_labels_against_walking(spark):
    parents = forest(5, 220)
    h, want = build(spark, parents), brute(parents)
    assert {r.node: (r.root, r.depth) for r in h.roots().collect()} == want
    rows = {r.node: r for r in h.labelled().collect()}
    good = {n for n, (_, depth) in want.items() if depth >= 0}
    assert set(rows) == good
    for n, r in rows.items():
        assert (r.root, r.depth) == want[n]
        assert r.path[0] == r.root and r.path[-1] == n and len(r.path) == r.depth + 1
        assert all(parents[b] == a for a, b in zip(r.path, r.path[1:]))
        below = {m for m in good if n in rows[m].path and m != n}
        inside = {m for m, x in rows.items() if x.root == r.root and r.first < x.first <= r.last}
        assert below == inside and r.size == len(below) + 1


def test_cycles(spark):
    got = {r.node: (r.cycle_id, r.length) for r in build(spark, {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c3", "self": "self", "a": None}).cycles().collect()}
    assert got == {"c1": ("c1", 3), "c2": ("c1", 3), "c3": ("c1", 3), "self": ("self", 1)}


def test_star_and_long_chain(spark):
    parents = {"root": None} | {f"s{i}": "root" for i in range(300)} | {f"k{i}": (f"k{i - 1}" if i else "root") for i in range(130)}
    got = {r.node: r.depth for r in build(spark, parents).roots().collect()}
    assert got["k129"] == 130 and got["s7"] == 1 and len(got) == 431


def test_links_of_dirty_rows(spark):
    rows = [(" A", " b ", T0, 1), ("a", "C", T1, 1), ("b", "", T0, 2), (None, "b", T0, 1), ("  ", "b", T0, 1), ("d", None, T0, 1), ("d", None, T0, 1)]
    got = {(r.node, r.parent) for r in parent_links(spark.createDataFrame(rows, LINK), "id", "parent", "ingested_at").collect()}
    assert got == {("a", "c"), ("b", None), ("d", None)}


def test_empty(spark):
    h = Hierarchy(spark.createDataFrame([], "node string, parent string"))
    assert h.roots().count() == 0 and h.labelled().count() == 0 and h.cycles().count() == 0
