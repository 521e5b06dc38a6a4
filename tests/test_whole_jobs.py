"""Queries that must do the whole job, on small tables of their own, against brute force."""

import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import weftline.plans  # noqa: F401
from weftline import catalog
from weftline.functions.text import fold_accents
from weftline.operators import entity, simulate


def run(spark, tmp_path, query, rows, schema, table):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    return catalog.QUERIES[query](spark, str(tmp_path)).collect()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_best_match_is_sought_among_all_names(spark, tmp_path):
    names = ["Karanis", "Aranis", "Kerkesis", "Theadelphia", "Philadelphia", "Oxyrhyncha", "Syron", "Psyron", "KARANIS", None]
    got = {r["q"]: (r["best"], r["score"]) for r in run(spark, tmp_path, "fuzzy_best", [(n,) for n in names + names[:3]], "place_name string", "place_reference")}
    score = lambda a, b: 1 - distance(a.lower(), b.lower()) / max(len(a), len(b))
    some = [n for n in names if n]
    best = {q: min((c for c in some if c != q), key=lambda c: (-round(score(q, c), 9), c)) for q in some}
    assert got == {q: (c, round(score(q, c), 6)) for q, c in best.items()}
    assert got["Syron"][0] == "Psyron" and got["Theadelphia"][0] == "Philadelphia"


def test_name_pairs_follow_the_rule(spark, tmp_path):
    names = ["Ζήνων Θέωνος", "Ζήνων Θέωνος, φύλαξ", "Θέωνος Ζήνων", "Ζήνωνι", "Ζήνων Διδύμου", "Θέων", "ΖΗΝΩΝ ΘΕΩΝΟΣ", "Δίδυμος Ζήνωνος, ἱερεύς", None]
    people = [(i, a, n, y) for i, (a, n, y) in enumerate((a, n, y) for a in ("a", "b", None) for n in names for y in ((100, 120), (None, 900), None))]
    table = "person_id long, archive_key string, canonical_name string, year_range struct<year_from int, year_to int>"
    got = [(r["a"], r["b"]) for r in run(spark, tmp_path, "name_pairs", people, table, "canonical_persons")]
    read = spark.createDataFrame([(n,) for n in names if n], "n string").select("n", fold_accents(F.lower("n")).alias("f"), entity.stems(F.col("n")).alias("s")).collect()
    folded, stems = {r["n"]: r["f"] for r in read}, {r["n"]: r["s"] for r in read}

    def near(x, y):
        if x is None or y is None:
            return True
        lo = lambda r: r[0] if r[0] is not None else r[1]
        return lo(x) - 200 <= y[1] and lo(y) - 200 <= x[1]

    def one(x, y):
        s, z = stems[x], stems[y]
        return folded[x] == folded[y] or (s == z and len(" ".join(s)) >= 4) or len({*s} & {*z}) / len({*s} | {*z}) >= 0.5

    want = [(i, j) for i, a, n, x in people for j, b, m, y in people if i < j and a and a == b and n and m and near(x, y) and one(n, m)]
    assert sorted(got) == want
    assert (0, 3) in got and (0, 4) not in got  # with and without a remark; dates that rule it out


def shortest_way_shares(edges):
    """Normalised betweenness by counting, for each pair of vertices, the shortest ways through each third one."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    dist, ways = {}, {}
    for s in near:
        dist[s], ways[s], front = {s: 0}, {s: 1}, [s]
        while front:
            new = []
            for v in front:
                for w in near[v]:
                    if w not in dist[s]:
                        dist[s][w], ways[s][w] = dist[s][v] + 1, 0
                        new.append(w)
                    if dist[s][w] == dist[s][v] + 1:
                        ways[s][w] += ways[s][v]
            front = new
    n = len(near)
    through = lambda s, v, t: v in dist[s] and t in dist[v] and t in dist[s] and dist[s][v] + dist[v][t] == dist[s][t]
    return {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in near for t in near if len({s, v, t}) == 3 and through(s, v, t)) / max(1, (n - 1) * (n - 2)) for v in near}


def test_betweenness_scores_the_places_of_the_documents(spark, tmp_path):
    rnd = random.Random(4)
    docs = [(i, f" place{rnd.randrange(30)}", None, [f"n{rnd.randrange(40)}" for _ in range(3)]) for i in range(130)] + [(900, "lone", None, ["x"]), (901, None, None, ["n1", "n2"])]
    docs += [(1000 + i, p, None, [f"far{k}", f"off{k}"]) for i, (p, k) in enumerate([("q1", 1), ("q2", 1), ("q2", 2), ("q3", 2)])]  # a component of its own
    got = {r["id"]: r["betweenness"] for r in run(spark, tmp_path, "betweenness", docs, "row_no long, place string, archive_key string, person_names array<string>", "papyri_documents")}
    at = {}
    for _, place, _, names in docs:
        if place:
            at.setdefault(place.strip(), set()).update(names)
    want = shortest_way_shares([(a, b) for a in at for b in at if a < b and len(at[a] & at[b]) >= 2])
    assert len(want) > 15 and {"q1", "q2", "q3"} < set(want) and want["q2"] > 0
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_suppliers_share_orders_of_any_quantity(spark, tmp_path):
    lines = [(1, 1, 1.0), (1, 2, 50.0), (2, 2, 3.0), (2, 3, 49.0), (3, 4, 2.0), (3, 5, 2.0), (4, 6, 50.0), (5, 5, 1.0), (5, None, 1.0)]
    got = run(spark, tmp_path, "supplier_components", lines, "l_orderkey long, l_suppkey long, l_quantity double", "lineitem")
    assert {r["id"]: r["component"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_every_name_is_folded(spark, tmp_path):
    names = ["Ζήνων", "Ζή\u0301νων", "Ζη\u0301νων", "Ἀπολλώνιος", "Ζήνων, φύλαξ", "Zén\u200bon", "Ὥρος (?)", "", None]
    got = {r["our_name"]: r["folded"] for r in run(spark, tmp_path, "accent_fold", [(n,) for n in names], "our_name string", "trismegistos_matches_top50")}
    bare = lambda n: "".join(c for c in unicodedata.normalize("NFD", n) if unicodedata.category(c) != "Mn").lower().replace("ς", "σ")
    assert got == {n: bare(n) for n in names if n is not None}


def test_only_missing_keys_are_fetched(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (6, "d")], "n long, k string")
    cache, asked = spark.createDataFrame([("a", 10), ("z", 99)], "k string, v int"), []

    def fetch(keys):
        asked.extend(r["k"] for r in keys.collect())
        return spark.createDataFrame([("b", 20), ("d", None)], "k string, v int")

    got, grown = entity.through_cache(df, "k", cache, "v", fetch)
    assert sorted(asked) == ["b", "c", "d"]
    assert {r["n"]: (r["v"], r["cached"]) for r in got.collect()} == {1: (10, True), 2: (20, False), 3: (20, False), 4: (None, False), 5: (None, False), 6: (None, False)}
    assert sorted((r["k"], r["v"]) for r in grown.collect()) == [("a", 10), ("b", 20), ("z", 99)]


def test_reduction(spark, tmp_path):
    people = [(i, "a", n, 1, None) for i, n in enumerate(["Ζήνων Θέωνος", "Ζήνων Θέωνος, φύλαξ", "Δίδυμος Σακύτου", "Ζήνων Θέωνος"])]
    table = "person_id long, archive_key string, canonical_name string, mention_count int, year_range struct<year_from int, year_to int>"
    assert [tuple(r) for r in run(spark, tmp_path, "name_reduction", people, table, "canonical_persons")] == [(4, 2, 50.0)]
    assert entity.reduction(spark.range(0), spark.range(0)).first()["reduction_pct"] is None


def test_walks_never_bring_the_model_to_the_driver(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["the"] * 30 + [f"w{i}" for i in range(400)] + ["ᾄβ", "ζ"]
    texts = [[rnd.choice(words) for _ in range(20)] for _ in range(1_000)]
    n = Counter((" ".join(t[i : i + 2]), t[i + 2]) for t in texts for i in range(18))
    model = spark.createDataFrame([(a, b, k) for (a, b), k in n.items()], "a string, b string, n long").repartition(3)
    with monkeypatch.context() as m:
        for f in ("collect", "toArrow", "toPandas", "toLocalIterator"):
            m.setattr(type(model), f, lambda *_: pytest.fail("fetched by the driver"))
        made = simulate.markov_text(model, "a", "b", "n", [], 50, 6, 42, order=2)
    table = {}
    for (a, b), k in sorted(n.items()):
        table.setdefault(a, []).append((b, k))
    keys = sorted(table)
    want = []
    for i in range(6):
        g = np.random.Generator(np.random.Philox(key=[42, i]))
        seq = keys[int(g.integers(len(keys)))].split(" ")
        while len(seq) < 50:
            at = table.get(" ".join(seq[-2:]))
            if at is None:
                seq += keys[int(g.integers(len(keys)))].split(" ")
            else:
                cum = np.cumsum([k for _, k in at]) / sum(k for _, k in at)
                seq.append(at[int(np.searchsorted(cum, g.random()))][0])
        want.append(seq[:50])
    assert [r["tokens"] for r in made.orderBy("run").collect()] == want
