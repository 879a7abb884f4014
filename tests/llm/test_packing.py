import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import packing as P


def optimum(sizes, capacity):
    """The least number of containers, by search."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in sorted(set(range(len(bins))), key=lambda k: bins[k]):
            if bins[k] + sizes[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=8))
def test_bound_and_packing_enclose_the_optimum(sizes):
    s = np.array(sizes, dtype=np.int64)
    bins = P.best_fit_decreasing(s, 20)
    fill = np.bincount(bins, weights=s) if len(s) else np.array([])
    assert not len(s) or fill.max() <= 20
    used = int((fill > 0).sum())
    assert P.lower_bound(s, 20) <= optimum(sizes, 20) <= used


def rows(spark, sizes):
    return spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id bigint, tokens bigint, container string")


@pytest.mark.parametrize("group", [1000, 7])
def test_every_piece_once(spark, group):
    sizes = [0, 5, 2048, 2049, 5000, None, 1, 1, 1, *[300 + 37 * i % 900 for i in range(60)], *[1000] * 9]
    got = P.pack(rows(spark, sizes), 2048, group_items=group).collect()
    per, fill = {}, {}
    for r in got:
        per.setdefault(r.item_id, {})[r.piece] = r.size
        fill[r.container] = fill.get(r.container, 0) + r.size
    assert per == {i: {k: min(2048, s - 2048 * k) for k in range(max(1, -(-s // 2048)))} for i, s in enumerate(sizes) if s is not None}
    assert max(fill.values()) <= 2048
    bound = P.lower_bound(np.array([x for v in per.values() for x in v.values()]), 2048)
    assert sum(v > 0 for v in fill.values()) <= bound + (2 if group > 100 else 6)
    assert P.certificates(P.pack(rows(spark, sizes), 2048)).count() >= 1


def test_empty(spark):
    assert P.pack(rows(spark, []), 2048).count() == 0
