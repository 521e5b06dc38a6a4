import numpy as np
from pyspark.sql import functions as F

from weftline.operators.vectors import search_index

SCHEMA = "vec_id long, embedding array<float>, id string"


def table(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "clash") for i, row in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def brute(x, q, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = u[q] @ u.T
    s[np.arange(len(q)), q] = -2
    return {(int(a), int(b)) for a, row in zip(q, np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]) for b in row}


def test_recall_against_brute_force_with_a_hot_list(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 16))
    x = np.vstack([centre[rng.integers(0, 30, 1400)] + 0.3 * rng.normal(size=(1400, 16)), centre[0] + 0.1 * rng.normal(size=(700, 16))])  # a third in one place
    df = table(spark, x)
    q = np.arange(0, len(x), 20)
    got = search_index(df, df.filter("vec_id % 20 = 0"), "vec_id", "embedding", part_rows=100)
    pairs = {(r["query_id"], r["id"]) for r in got.collect()}
    want = brute(x, q, 5)
    assert len(pairs) == 5 * len(q) and len(pairs & want) >= 0.9 * len(want)


def test_all_lists_probed_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 8)).astype(np.float32).astype(float)
    df = table(spark, x)
    got = search_index(df, df.filter("vec_id < 10"), "vec_id", "embedding", lists=6, probes=6, part_rows=7)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == brute(x, np.arange(10), 5)


def test_ties_nulls_zero_vectors_and_empty_tables(spark):
    df = table(spark, [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 0.0]]).unionAll(spark.createDataFrame([(9, None, ""), (None, [1.0, 0.0], "")], SCHEMA))
    got = search_index(df, df.filter("vec_id = 0 or vec_id = 9"), "vec_id", "embedding", k=2, lists=2, probes=2).orderBy("rk").collect()
    assert [(r["query_id"], r["id"], round(r["cosine"], 6)) for r in got] == [(0, 1, 1.0), (0, 2, 1.0)]
    assert search_index(df.limit(0), df, "vec_id", "embedding").count() == 0
    assert search_index(df, df.limit(0), "vec_id", "embedding").count() == 0
    assert df.filter(F.col("id") == "clash").count() == 4
