from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from weftline.operators.intervals import merge_intervals, merge_sorted, merge_states, spans_and_gaps

SCHEMA = "k string, lo int, hi int, spans string"


def brute(rows):
    years = {}
    for k, a, b in rows:
        if k is None or (a is None and b is None):
            continue
        a, b = (b if a is None else a), (a if b is None else b)
        years.setdefault(k, set()).update(range(min(a, b), max(a, b) + 1))
    out = {}
    for k, ys in years.items():
        s = sorted(ys)
        spans = []
        for y in s:
            if spans and y == spans[-1][1] + 1:
                spans[-1][1] = y
            else:
                spans.append([y, y])
        out[k] = [x for p in spans for x in p]
    return out


@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(0, 6)), max_size=30))
def test_merge_sorted_matches_sets_of_years(iv):
    iv = sorted((a, a + n) for a, n in iv)
    lo, hi = merge_sorted(np.array([a for a, _ in iv], dtype=np.int64), np.array([b for _, b in iv], dtype=np.int64))
    assert [x for p in zip(lo.tolist(), hi.tolist()) for x in p] == brute([("k", a, b) for a, b in iv]).get("k", [])


@given(st.lists(st.lists(st.tuples(st.integers(-20, 20), st.integers(0, 4)), max_size=6), max_size=5))
def test_states_merge_in_any_grouping(parts):
    flat = [[x for a, n in p for x in (a, a + n)] for p in parts]
    states = [merge_states([np.array(f, dtype=np.int64)]) for f in flat]
    whole = merge_states([np.array([x for f in flat for x in f], dtype=np.int64)])
    assert merge_states(states).tolist() == whole.tolist()
    assert merge_states([merge_states(states[:2]), merge_states(states[2:])]).tolist() == whole.tolist()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-40, 40)), st.one_of(st.none(), st.integers(-40, 40))), max_size=40))
def test_operator_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = {r["k"]: list(r["spans"]) for r in merge_intervals(df, ["k"], "lo", "hi", fan_in=2, flush_rows=4).collect()}
    assert got == brute(rows)


def test_gaps_lie_between_periods(spark):
    df = spark.createDataFrame([("a", 1, 3, ""), ("a", 9, 8, ""), ("a", 4, None, ""), ("b", 0, 0, "")], SCHEMA)
    rows = {(r["k"], r["span_kind"], r["lo"], r["hi"]) for r in spans_and_gaps(merge_intervals(df, ["k"], "lo", "hi")).collect()}
    assert rows == {("a", "period", 1, 4), ("a", "gap", 5, 7), ("a", "period", 8, 9), ("b", "period", 0, 0)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert spans_and_gaps(merge_intervals(df, ["k"], "lo", "hi")).count() == 0


def test_hot_key_is_folded_before_the_shuffle(spark):
    df = spark.range(20_000).selectExpr("'hot' as k", "cast(id % 50 * 3 as int) as lo", "cast(id % 50 * 3 as int) as hi").repartition(4)
    out = merge_intervals(df, ["k"], "lo", "hi").collect()
    assert len(out) == 1 and len(out[0]["spans"]) == 100
