import numpy as np

from corpusloom.llm import neighbours as N
from corpusloom.llm import queries as Q

SCHEMA = "vec_id bigint, embedding array<float>, dim int, proj string"


def brute(v, k, least):
    ids = sorted(v)
    x = np.array([v[i] / np.linalg.norm(v[i]) for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k] if s[a, b] >= least}


def data(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, dim))
    v = np.repeat(base, 4, axis=0) + rng.standard_normal((n // 4 * 4, dim)) * rng.choice([0.1, 0.3, 3.0], (n // 4 * 4, 1))
    return {i: v[i].astype(np.float32) * rng.uniform(0.1, 9) for i in range(len(v))}


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, [float(y) for y in x], len(x), "x") for i, x in v.items()] + list(extra), SCHEMA)


def test_quantile():
    assert abs(N.chi_square_quantile(0.99, 12) - 26.217) < 0.1


def test_tail_and_sides():
    assert [round(N.chi_square_tail(k, x), 4) for k, x in ((1, 3.841), (2, 5.991), (5, 11.07), (8, 15.507))] == [0.05] * 4
    sides = N.reach_of_sides(0.05)
    assert np.isinf(sides[0]) and np.isnan(sides[5:]).all() and (np.diff(sides[1:5]) < sides[1]).all()
    assert abs(0.5**2 * N.chi_square_tail(2, float(sides[2])) - 0.05) < 1e-4


def test_few_cells_are_visited_and_few_points_verified():
    """At 20,000 points a query for pairs of 0.86 verifies under 1 % of them, and finds the pairs at the edge."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal((300, 64)).astype(np.float32)
    side -= (side * x[:300]).sum(1)[:, None] * x[:300]
    q = 0.87 * x[:300] + np.sqrt(1 - 0.87**2) * side / np.linalg.norm(side, axis=1)[:, None]
    d = N.directions(64)
    tree, verified = N.Tree(x @ d, 64), []
    needed = tree.needed(q @ d, N.reach_of_sides(N.CHANCE))
    best, _ = N.search(np.arange(20_000), x, x @ d, tree, np.arange(20_000, 20_300), q, q @ d, np.full(300, 0.28), 5, 0.86, N.reach_of_sides(N.CHANCE), verified)
    assert (needed <= 0.28).mean() < 0.25 and sum(verified) < 0.01 * 300 * 20_000
    assert (best[:, 0] == np.arange(300)).mean() >= 0.9


def test_against_brute_force_in_many_cells(spark):
    v = data(1200)
    want = brute({i: x.astype(float) for i, x in v.items()}, 5, 0.86)
    near = N.neighbours(frame(spark, v), 5, 0.86, block=100)
    got = {(min(r.vec_id, r.other), max(r.vec_id, r.other)) for r in near.collect()}
    assert len(want) > 300 and len(want & got) >= 0.98 * len(want) and not got - want


def test_copies_unusable_and_widths(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.1, 0.0]
    nan = float("nan")
    extra = [(9, None, 3, "x"), (10, [1.0], 3, "x"), (11, [nan, 1.0, 1.0], 3, "x"), (12, [0.0, 0.0, 0.0], 3, "x"), (13, [1.0, None, 1.0], 3, "x"), (14, [1.0, 0.0], 2, "x"), (15, a, None, "x"), (0, a, 3, "x"), (16, [float("inf"), 1.0, 1.0], 3, "x")]
    v = {i: np.array(a) for i in range(4)} | {4: np.array(b)}
    got = {tuple(r) for r in N.similar_pairs(frame(spark, v, extra)).collect()}
    assert got == {(i, j) for i in range(5) for j in range(i + 1, 5)}


def test_large_group_of_copies_stays_linear(spark):
    v = {i: np.array([1.0, 2.0]) for i in range(400)} | {1000: np.array([1.0, 2.1])}
    near = N.neighbours(frame(spark, v)).collect()
    assert len(near) == 401 * 5 and all(r.vec_id != r.other for r in near)


def test_empty(spark):
    assert N.similar_pairs(frame(spark, {})).count() == 0


def test_query_gives_five_for_every_vector(spark, tmp_path):
    """However far away they are: vectors without structure, and a pair of opposite ones of another width."""
    v = {i: x for i, x in enumerate(np.random.default_rng(3).standard_normal((300, 24)).astype(np.float32))} | {900: np.array([1.0, 2.0]), 901: np.array([-1.0, -2.0])}
    frame(spark, v).write.parquet(str(tmp_path / "embedding_cache.parquet"))
    got = {}
    for r in Q.p7_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, {})[r.other] = r.similarity
    assert len(got) == 302 and all(len(o) == 5 for i, o in got.items() if i < 900) and got[900].keys() == {901} and got[901].keys() == {900}
    x = np.array([v[i] / np.linalg.norm(v[i]) for i in range(300)])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    hit = sum(len(set(np.argsort(-s[i])[:5].tolist()) & got[i].keys()) for i in range(300))
    assert hit >= 0.98 * 1500


def test_cells_are_used(spark, monkeypatch):
    plan, trees = N._plan, {}
    monkeypatch.setattr(N, "_plan", lambda *a: trees.update(plan(*a)) or trees)
    v = data(1200)
    want = brute({i: x.astype(float) for i, x in v.items()}, 5, 0.86)
    near = N.neighbours(frame(spark, v), 5, 0.86, block=100)
    got = {(min(r.vec_id, r.other), max(r.vec_id, r.other)) for r in near.collect()}
    assert trees[24][0].leaves == 16 and len(want & got) >= 0.98 * len(want) and not got - want
