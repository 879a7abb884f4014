from datetime import datetime, timedelta

from corpusloom.operators import orphans as O

T = datetime(2025, 3, 1)
REF = "artifact_id string, run_id string, trace_id string, ts timestamp, ingested_at timestamp, reason string"
PAR = "run_id string, ingested_at timestamp"
LOG = "table_name string, record_id string, pruned_at timestamp"


def day(n):
    return T + timedelta(days=n)


def refs(spark, rows):
    return O.references(spark.createDataFrame(rows, REF), "artifacts", "artifact_id", {"run_id": "runs", "trace_id": "llm_calls"})


ROWS = [
    ("a1", " R1 ", None, day(0), day(1), "x"),
    ("a1", "r1", None, day(0), day(5), "x"),  # a repeated row
    ("a2", "gone", "  ", day(0), day(1), "x"),
    ("a3", "late", "", day(40), day(1), "x"),
    ("a4", "pruned", None, day(0), day(1), "x"),
    ("a5", "again", None, None, day(1), "x"),
    (None, "gone", None, day(0), day(1), "x"),
]
PARENTS = [("r1", day(0)), ("LATE", day(9)), ("pruned", day(0)), ("again", day(0)), ("again", day(8)), (None, day(0))]
DELETED = [("runs", "pruned", day(2)), ("runs", "PRUNED", day(2)), ("runs", "again", day(3)), ("llm_calls", "r1", day(9)), (None, None, None)]
WANT = {("a2", "missing", "2025-03"), ("a3", "late", "2025-04"), ("a4", "deleted", "2025-03")}


def parents(spark, rows, log):
    p = O.parent_times(spark.createDataFrame(rows, PAR), "runs", "run_id")
    return p.unionByName(O.deletions(spark.createDataFrame(log, LOG)))


def found(df):
    return {(r.record_id, r.reason, r.period) for r in df.collect()}


def test_reasons(spark):
    assert found(O.OrphanState.empty(spark).apply(refs(spark, ROWS), parents(spark, PARENTS, DELETED)).orphans()) == WANT


def test_batches_give_what_one_batch_gives(spark):
    step = lambda state, rows, new, log: state.apply(refs(spark, rows), parents(spark, new, log), lambda df: df.cache())
    state = step(O.OrphanState.empty(spark), ROWS[:3], PARENTS[:1], [])
    assert found(state.orphans()) == {("a2", "missing", "2025-03")}
    state = step(state, ROWS[3:], [], [])
    assert {r for _, r, _ in found(state.orphans())} == {"missing"} and state.orphans().count() == 4
    state = step(state, [], PARENTS[1:], [])  # parents arrive
    assert found(state.orphans()) == {("a2", "missing", "2025-03"), ("a3", "late", "2025-04")}
    state = step(state, [], [], DELETED)  # deletions reopen
    assert found(state.orphans()) == WANT
    counts = {(r.reason, r.period): r.orphans for r in state.snapshot().collect()}
    assert counts == {("missing", "2025-03"): 1, ("late", "2025-04"): 1, ("deleted", "2025-03"): 1}


def test_only_changed_keys_are_evaluated(spark):
    state = O.OrphanState.empty(spark).apply(refs(spark, ROWS), parents(spark, PARENTS, []), lambda df: df.cache())
    after = state.apply(refs(spark, []), parents(spark, [("gone", day(0))], []), lambda df: df.cache())
    assert after.added.count() == 0 and [r.ref for r in after.changed.collect()] == ["gone"] and found(after.orphans()) == {("a3", "late", "2025-04")}


def test_a_record_that_comes_again(spark):
    """Its first ingestion is the earlier one, whichever batch brings it, for all its references."""
    state = O.OrphanState.empty(spark).apply(refs(spark, [("a", "x", None, day(50), day(9), "")]), parents(spark, [("x", day(5)), ("y", day(5))], []), lambda df: df.cache())
    assert found(state.orphans()) == set()
    state = state.apply(refs(spark, [("a", "y", None, day(0), day(1), "")]), parents(spark, [], []), lambda df: df.cache())
    assert {(r.ref, r.reason, r.period) for r in state.orphans().collect()} == {("x", "late", "2025-03"), ("y", "late", "2025-03")}


def test_empty(spark):
    assert O.OrphanState.empty(spark).apply(refs(spark, []), parents(spark, [], [])).orphans().count() == 0
