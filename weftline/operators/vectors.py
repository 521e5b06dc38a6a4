"""Nearest vectors by cosine through an inverted file.

Centres are fitted on a bounded sample by spherical k-means; every vector is filed under its nearest centre, and a query
looks into the lists of the centres nearest to it.  What it finds there is compared exactly.  A list that many vectors
fall into is split into parts that are searched by different tasks, so no list has to fit one of them.

Defined results
---------------
* null vectors and null ids are not filed and not sought; a zero vector has cosine 0 with all;
* a vector is not its own neighbour; equally near neighbours: the smaller id comes first (cosines to nine digits);
* repeated ids count as often as they occur; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: most vectors that the centres are fitted on, and most centres
MAX_SAMPLE, MAX_LISTS = 20_000, 4_096


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of unit length; a zero vector stays zero."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    m = np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1) if len(col) else np.empty((0, 0))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def sample_vectors(df: DataFrame, key: str, vector: str, sample: int = MAX_SAMPLE) -> np.ndarray:
    """At most ``sample`` vectors, those of the smallest hash, as rows of unit length."""
    return _matrix(df.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key, F.lit(3)), key).limit(sample).select(vector).toArrow().column(0))


def fit_centres(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """``lists`` centres (fewer if there are fewer vectors) of a sample of unit vectors."""
    if not len(x):
        return x
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c)
    return c


def tune_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 200) -> int:
    """The fewest lists that hold the share ``recall`` of the ``k`` nearest within a sample, read off ``asked`` vectors of it."""
    if len(x) < 2:
        return 1
    q = np.unique(np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int))
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -2.0
    near = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
    home = (x @ centres.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(x[q] @ centres.T), axis=1), axis=1)  # the turn in which a query comes to each list
    turn = np.take_along_axis(rank, home[near], axis=1).ravel()
    return int(np.quantile(turn, recall, method="higher")) + 1


def file_vectors(df: DataFrame, key: str, vector: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``(id, list, v)``: every vector with each of its ``probes`` nearest centres."""
    probes = min(probes, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not probes:
                continue
            s = _matrix(b.column(1)) @ centres.T
            top = np.argpartition(-s, probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(b.num_rows), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(top.ravel().astype(np.int32)), b.column(1).take(at)], ["id", "list", "v"])

    src = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter("id is not null and v is not null")
    return src.mapInArrow(run, "id bigint, list int, v array<float>")


def search_index(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, lists: int | None = None, probes: int | None = None, part_rows: int = 4_000, recall: float = 0.96) -> DataFrame:
    """``(query_id, id, rk, cosine)``: the ``k`` nearest vectors of ``df`` for every one of ``queries``, by an index over all rows.

    ``lists`` defaults to the square root of the number of vectors, ``probes`` to as many as find ``recall`` of the neighbours
    within the sample; vectors without any structure need most of the lists."""
    if lists is None:
        lists = int(min(MAX_LISTS, max(8, df.filter(F.col(vector).isNotNull()).count() ** 0.5)))
    x = sample_vectors(df, key, vector)
    centres = fit_centres(x, min(lists, MAX_LISTS))
    probes = probes or tune_probes(x, centres, k, recall)
    base = file_vectors(df, key, vector, centres)
    parts = base.groupBy("list").agg(F.ceil(F.count("*") / F.lit(float(part_rows))).cast("int").alias("parts"))  # a row per list
    left = base.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("list", "part", "id", "v")
    right = file_vectors(queries, key, vector, centres, probes).join(F.broadcast(parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "id", "v")

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, q_ids = rows.column("id").to_numpy(), asked.column("id").to_numpy()
        out = []
        if len(ids) and len(q_ids):
            v, q = _matrix(rows.column("v")), _matrix(asked.column("v"))
            m = min(k, len(ids))
            for a in range(0, len(q), 1024):
                s = q[a : a + 1024] @ v.T
                s[q_ids[a : a + 1024, None] == ids[None, :]] = -2.0
                top = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :m] if len(ids) <= 4 * m else np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append((np.repeat(q_ids[a : a + 1024], m), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": cols[0].astype(np.int64), "id": cols[1].astype(np.int64), "cosine": cols[2].astype(np.float64)})

    hits = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(best, "query_id bigint, id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return hits.filter("cosine > -2").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k).select("query_id", "id", "rk", "cosine")
