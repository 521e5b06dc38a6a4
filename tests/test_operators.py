"""Operators on small fixtures: nulls, ties, repeated rows, empty tables, brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions.text import fold_accents
from weftline.operators import entity, graph, models, quality, relational, sequences, series, simulate, stats


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_asof_takes_the_last_value_at_or_before(spark):
    a = spark.createDataFrame([("k", 5), ("k", 10), ("k", 1), ("x", 3)], "k string, at int")
    b = spark.createDataFrame([("k", 2, 1.0), ("k", 5, 2.0), ("k", 9, None)], "k string, at int, v double")
    assert rows(series.asof(a, b, ["k"], "at", "v").fillna(-1.0)) == [("k", 1, -1.0), ("k", 5, 2.0), ("k", 10, 2.0), ("x", 3, -1.0)]
    assert rows(series.asof(a, b, ["k"], "at", "v", strict=True).fillna(-1.0)) == [("k", 1, -1.0), ("k", 5, 1.0), ("k", 10, 2.0), ("x", 3, -1.0)]


def test_lags_go_by_time_and_not_by_position(spark):
    d = dt.datetime
    s = spark.createDataFrame([(d(2024, 1, 1), 1.0), (d(2024, 1, 3), 3.0), (d(2024, 1, 4), 4.0)], "at timestamp, v double")
    assert rows(series.with_lags(s, "at", "v", {"p": "1 day"}), "v", "p") == [(4.0, 3.0)]


def test_budget_load_matches_brute_force(spark):
    rnd = random.Random(1)
    t0 = dt.datetime(2024, 1, 1)
    calls = [(i, t0 + dt.timedelta(seconds=rnd.random() * 500), float(rnd.randrange(5))) for i in range(200)]
    got = {r["i"]: r["spent"] for r in series.budget_load(spark.createDataFrame(calls, "i int, ts timestamp, u double"), "ts", "u", 60).collect()}
    for i, ts, _ in calls:
        assert got[i] == sum(u for _, o, u in calls if dt.timedelta(0) <= ts - o < dt.timedelta(seconds=60))


def test_skill_with_gaps_and_flat_series(spark):
    s = spark.createDataFrame([(1.0, 1.0), (2.0, None), (None, 3.0), (1.0, 3.0)], "y double, f double")
    r = s.agg(*series.skill(F.col("y"), F.col("f"))).first()
    assert (r["n"], r["bias"], r["r"], r["r2"]) == (2, 1.0, None, None)


def test_crossings_and_ties(spark):
    e = spark.createDataFrame([(1, 1, 9, 9), (1, 2, 10, 10), (2, 1, 3, 0), (3, 5, 11, 2)], "g int, n int, h int, a int")
    sides = {"home": "h", "away": "a"}
    assert rows(sequences.first_crossing(e, ["g"], ["n"], sides, 10, first="away")) == [(1, "away"), (3, "home")]
    assert {r["g"]: r["winner"] for r in sequences.first_crossing(e, ["g"], ["n"], sides, 10, tie="null").collect()} == {1: None, 3: "home"}


def test_global_rank_is_a_total_order(spark):
    df = spark.range(5000).withColumn("n", F.col("id") % 7).repartition(6)
    got = sequences.global_rank(df, [F.col("n").desc(), F.col("id").asc()]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(-r["n"], r["id"]) for r in got] == sorted((-r["n"], r["id"]) for r in got)
    assert sequences.global_rank(df.limit(0), [F.col("id").asc()]).count() == 0


def test_ngrams_and_adjacent_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "|", "b", "c"]), (2, ["x"]), (3, None)], "k int, t array<string>")
    assert [r["gram"] for r in sequences.ngrams(df, ["k"], F.col("t"), 2, boundary="|").collect()] == [["b", "c"]]
    e = spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 3, "a"), (1, 4, "a"), (1, 5, None)], "k int, n int, v string")
    assert rows(sequences.drop_adjacent_repeats(e, ["k"], ["n"], "v"), "n") == [(1,), (3,), (5,)]


def test_streaks(spark):
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 3, 3, 2, 9, 8])], "at int, v double")
    assert rows(series.streaks(s, "at", "v"), "length", "first_at", "last_at") == [(1, 4, 4), (1, 6, 6), (2, 1, 2)]


def test_relational_small(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k int, v string")
    assert rows(relational.keep_first(a, ["k"], ["v"]).fillna("-")) == [(1, "x"), (2, "-")]
    u = spark.createDataFrame([(1, "n"), (1, "m"), (2, "q")], "k int, v string")
    assert rows(relational.update_if_single(a, "k", u, "k", "v")) == [(1, "x"), (1, "y"), (2, "q")]
    p, c = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 3, "t"), (1, 2, None)], "k int, n int, t string")
    got = {r["k"]: [(x["n"], x["t"]) for x in r["kids"]] for r in relational.nest(p, c, "k", ["n", "t"], "kids", ["n"]).collect()}
    assert got == {1: [(2, None), (3, "t")], 2: []}
    with pytest.raises(ValueError, match="zzz"):
        relational.reorder(a, ["k", "zzz"])
    m = relational.mirrored(spark.createDataFrame([(1.0, 2.0, -1.0, 0.3)], "h double, a double, d double, p double"), [("h", "a")], ["d"], ["p"])
    assert rows(m) == [(1.0, 2.0, -1.0, 0.3, False), (2.0, 1.0, 1.0, 0.7, True)]


def test_contains_match_equals_nested_loops(spark):
    rnd = random.Random(5)
    words = ["ash", "bury", "north", "state", "lake", "tech", "st"]
    name = lambda: " ".join(rnd.sample(words, rnd.randrange(1, 4)))
    left, right = {name() for _ in range(40)}, {name() for _ in range(40)}
    got = {(r["lt"], r["rt"]) for r in relational.contains_match(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), "a", "b").collect()}
    assert got == {(x, y) for x in left for y in right if f" {y} " in f" {x} " or f" {x} " in f" {y} "}


def test_statistics_against_brute_force(spark):
    import math
    from collections import Counter

    rnd = random.Random(2)
    toks = [rnd.choice("aabbbcdefg") for _ in range(400)]
    cnt = stats.counts(spark.createDataFrame([(t,) for t in toks], "t string"), [], "t")
    c = Counter(toks)
    assert stats.entropy(cnt, []).first()["entropy"] == pytest.approx(-sum(n / 400 * math.log2(n / 400) for n in c.values()))
    xs = sorted(c.values())
    n = len(xs)
    assert stats.gini(cnt).first()["gini"] == pytest.approx(sum((2 * i - n - 1) * x for i, x in enumerate(xs, 1)) / (n * sum(xs)))
    pairs = spark.createDataFrame(list(zip(toks, toks[1:])), "a string, b string")
    joint, ctx = Counter(zip(toks, toks[1:])), Counter(toks[:-1])
    want = -sum(v / 399 * math.log2(v / ctx[a]) for (a, _), v in joint.items())
    assert stats.conditional_entropy(pairs, [], "a", "b").first()["cond_entropy"] == pytest.approx(want)
    z = stats.zipf(spark.createDataFrame([("a", 3)], "t string, n long"), "t").first()
    assert (z["slope"], z["r2"]) == (0.0, 0.0)
    auc = stats.rank_auc(spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int"), "s", "y").first()["auc"]
    assert auc == pytest.approx(0.875)


def test_chains_stop_at_rings(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r["path"]) for r in stats.chains(links).collect()} == {("a", "b", "c"), ("x", "y")}


def union_find(edges):
    p = {}

    def f(x):
        p.setdefault(x, x)
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        x, y = f(a), f(b)
        p[max(x, y)] = min(x, y)
    return {x: f(x) for x in p}


def test_components_match_union_find(spark):
    rnd = random.Random(9)
    edges = [tuple(sorted(rnd.sample(range(300), 2))) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == union_find(edges)
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_betweenness_of_a_path_and_a_star(spark):
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = dict(rows(graph.betweenness(path)))
    assert got["a"] == 0 and got["b"] == pytest.approx(2 / 3) and got["c"] == pytest.approx(2 / 3)
    star = spark.createDataFrame([("m", x) for x in "abcd"], "src string, dst string")
    assert dict(rows(graph.betweenness(star)))["m"] == pytest.approx(1.0)


def test_pairs_within_a_group(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, "c"), (2, "a"), (2, None)], "g int, m string")
    assert rows(graph.pairs_within(df, "g", "m")) == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]


def test_same_person_rule(spark):
    cases = [("Theon", "Theon", (100, 100), (120, 120), True), ("Theon", "Demetrios", (100, 100), (120, 120), False), ("Theon", "Theon", (-300, -300), (500, 500), False),
             ("Ζήνωνι", "Ζήνωνος", None, None, True), ("Αὐρήλιος", "Αυρηλιος", (200, 250), (230, 280), True)]
    df = spark.createDataFrame([(i, a, b, *(r1 or (None, None)), *(r2 or (None, None)), ok) for i, (a, b, r1, r2, ok) in enumerate(cases)], "i int, a string, b string, l1 int, h1 int, l2 int, h2 int, ok boolean")
    got = df.select("i", "ok", entity.same_person(F.col("a"), F.col("b"), F.col("l1"), F.col("h1"), F.col("l2"), F.col("h2")).alias("v")).collect()
    assert [r["v"] for r in got] == [r["ok"] for r in got]


def test_greedy_clusters_and_merge(spark):
    names = [("Ζήνωνι", 50), ("Ζήνωνος", 30), ("Ζήνωνα", 10), ("Θέων", 5)]
    df = spark.createDataFrame([("k", i, n, c, 200 + i, 250 + i) for i, (n, c) in enumerate(names)], "b string, id int, name string, n int, lo int, hi int").withColumn("stems", entity.stems(F.col("name")))
    cl = entity.greedy_clusters(df, "b", "id", "stems", "n")
    out = entity.merge_records(df.join(cl.select("id", "leader"), "id"), "leader", "name", "n", "lo", "hi").orderBy("leader").collect()
    assert [(r["canonical_name"], len(r["variants"]), r["mention_count"], r["year_from"], r["year_to"]) for r in out] == [("Ζήνωνι", 3, 90, 200, 252), ("Θέων", 1, 5, 203, 253)]


def test_fold_accents(spark):
    assert spark.createDataFrame([("Αὐρήλιος É á",)], "s string").select(fold_accents(F.col("s")).alias("v")).first()["v"] == "Αυρηλιος E a"


def test_quality(spark, tmp_path):
    import gzip

    for n, body in {"ok.gz": gzip.compress(b'{"a":1}'), "empty.gz": b"", "plain.gz": b"{}", "cut.gz": gzip.compress(b'{"a":1}' * 50)[:20], "text.gz": gzip.compress(b"hello")}.items():
        (tmp_path / n).write_bytes(body)
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    files = files.unionByName(spark.createDataFrame([("x/empty.gz", bytearray())], "path string, content binary"))
    got = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in quality.file_problems(files).collect()}
    assert got == {"ok.gz": None, "empty.gz": "empty", "plain.gz": "not gzip", "cut.gz": "damaged", "text.gz": "no JSON"}
    m = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "failed")], "f string, status string")
    d = spark.createDataFrame([("a",), ("c",), ("d",)], "f string")
    assert rows(quality.repair(m, d, "f", "status")) == [("a", "ok", False), ("b", "missing", True), ("c", "ok", True), ("d", "ok", True)]
    with pytest.raises(ValueError, match="url"):
        quality.require_columns(m, ["url"])
    with pytest.raises(Exception, match="blank"):
        quality.not_blank(spark.createDataFrame([(" ",)], "f string"), "f").collect()


def test_simulations_repeat_and_add_up(spark):
    seeds = spark.createDataFrame([(i, float(r)) for i, r in enumerate([80, 70, 75, 72])], "slot long, rating double")
    exact = {(r["slot"], r["round"]): r["p"] for r in simulate.knockout_exact(seeds, "slot", "rating", 2, 11.0).collect()}
    assert sum(p for (_, k), p in exact.items() if k == 2) == pytest.approx(1.0)
    runs = simulate.knockout_runs(spark, [80, 70, 75, 72], 20_000, 11.0, 1)
    share = {(r["slot"], r["round"]): r["n"] / 20_000 for r in runs.groupBy("slot", "round").agg(F.count("*").alias("n")).collect()}
    assert all(abs(share.get(k, 0) - p) < 0.02 for k, p in exact.items())
    args = dict(sims=50, cycles=20, start=100.0, ruin=1.0, seed=3)
    a = rows(simulate.bankroll(spark, [(0.55, 2.0)], [1.0, 0.5], **args))
    assert a == rows(simulate.bankroll(spark, [(0.55, 2.0)], [1.0, 0.5], **args)) and len(a) == 100


def test_models(spark):
    rnd = random.Random(0)
    data = [(i, rnd.random(), rnd.random()) for i in range(300)]
    df = spark.createDataFrame([(i, a, b, 2 * a + 0.01 * b, float(a > 0.5)) for i, a, b in data], "id long, a double, b double, t double, y double")
    auc = stats.rank_auc(models.cross_validated(df, "id", "logistic", ["a", "b"], "y"), "score", "y").first()["auc"]
    assert auc > 0.97
    f = models.folds(df, "id", 3)
    assert f.groupBy("id").count().filter("count > 1").count() == 0 and f.select("fold").distinct().count() == 3
    ab = dict(rows(models.ablation(df, df, "linear", ["a", "b"], "t")))
    assert ab["a"] > 10 * ab["none"]
    m = models.make_model("ridge", ["a", "b"], "t").fit(df)
    imp = dict(rows(models.permutation_importance(m, df, "id", ["a", "b"], "t")))
    assert imp["a"] > imp["b"]


def test_betweenness_has_no_bound_on_edges(spark, monkeypatch):
    """Blocks of any number, chunks of few edges, ways not kept, and none of the edges at the driver."""
    rnd = np.random.default_rng(5)
    pairs = sorted({tuple(sorted(map(int, p))) for p in np.r_[rnd.integers(0, 60, (150, 2)), rnd.integers(60, 90, (40, 2))] if p[0] != p[1]})
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:  # Brandes, plainly
        dist, ways, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], ways[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
        back = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    back[v] += ways[v] / ways[w] * (1 + back[w])
            if w != s:
                want[w] += back[w]
    n = len(near)
    edges = spark.createDataFrame([(f"p{a:02}", f"p{b:02}") for a, b in pairs], "src string, dst string")
    with monkeypatch.context() as m:
        for f in ("toArrow", "toPandas", "toLocalIterator"):
            m.setattr(type(edges), f, lambda *_: pytest.fail("fetched by the driver"))
        got = graph.betweenness(edges)
    assert {r["id"]: r["betweenness"] for r in got.collect()} == pytest.approx({f"p{v:02}": x / ((n - 1) * (n - 2)) for v, x in want.items()})
    number = {v: i for i, v in enumerate(near)}
    lists = [np.array([number[w] for w in near[v]]) for v in near]
    deg = np.array([len(x) for x in lists])
    for chunk, kept in ((1 << 20, 1 << 23), (7, 20), (1, 0)):
        monkeypatch.setattr(graph, "CHUNK_EDGES", chunk)
        monkeypatch.setattr(graph, "KEPT_EDGES", kept)
        sums = sum(graph._dependencies(np.cumsum(deg) - deg, deg, np.concatenate(lists), s) for s in range(n))
        assert sums == pytest.approx([want[v] for v in near])
