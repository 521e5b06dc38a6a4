"""Overlapping, nested and gapped intervals: a mergeable aggregate of sorted disjoint spans.

The state of one entity is a flat, sorted list ``[lo0, hi0, lo1, hi1, ...]`` of disjoint closed
intervals, no two of which overlap or touch.  Two states merge linearly into one.  Scan tasks fold
their own rows into partial states first (no shuffle), a reduction tree then merges partial states
``fan_in`` at a time, so that no task ever holds an entity's raw rows, however hot the entity is.

Defined results
---------------
* an interval with both ends null is left out; one null end: the other stands for both ends;
* turned-round ends are exchanged;
* rows whose key is null in any key column are left out when ``drop_null_keys`` (default);
* repeated rows and ties change nothing; an empty input gives an empty result;
* other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_sorted(lo: np.ndarray, hi: np.ndarray, touch: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint spans of intervals given in order of ``lo``; spans at most ``touch`` apart become one."""
    if len(lo) == 0:
        return lo, hi
    reach = np.maximum.accumulate(hi)
    first = np.empty(len(lo), dtype=bool)
    first[0] = True
    first[1:] = lo[1:] > reach[:-1] + touch
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(lo)) - 1
    return lo[start], reach[end]


def merge_states(states: Sequence[np.ndarray], touch: int = 1) -> np.ndarray:
    """One state out of many.  The stable sort is a timsort over runs: a k-way linear merge of sorted lists."""
    flat = np.concatenate([np.asarray(s, dtype=np.int64) for s in states]) if len(states) else np.empty(0, np.int64)
    lo, hi = flat[0::2], flat[1::2]
    order = np.argsort(lo, kind="stable")
    lo, hi = merge_sorted(lo[order], hi[order], touch)
    out = np.empty(2 * len(lo), dtype=np.int64)
    out[0::2], out[1::2] = lo, hi
    return out


def _fold_partition(n_keys: int, touch: int, flush_rows: int):
    """mapInArrow body: (k0.., lo, hi) rows to one partial state per key and at most ``flush_rows`` rows."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = part = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, rows, part
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [t.column(i).combine_chunks() for i in range(n_keys)]
            codes = np.zeros(t.num_rows, dtype=np.int64)
            for k in keys:
                d = k.dictionary_encode() if not pa.types.is_dictionary(k.type) else k
                d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
                c = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (len(d.dictionary) + 1) + c, return_inverse=True)[1]
            lo = t.column("lo").to_numpy().astype(np.int64)
            hi = t.column("hi").to_numpy().astype(np.int64)
            order = np.lexsort((lo, codes))
            codes, lo, hi = codes[order], lo[order], hi[order]
            # keys are laid side by side on one axis, further apart than any span, and merged in one pass
            base, width = int(lo.min()), int(hi.max() - lo.min()) + touch + 2
            if int(codes[-1] + 1) * width < 2**62:
                at = codes * width
                mlo, mhi = merge_sorted(lo - base + at, hi - base + at, touch)
                mcode = mlo // width
                mlo, mhi = mlo - mcode * width + base, mhi - mcode * width + base
            else:
                cut = np.append(np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]), len(codes))
                parts = [(codes[a], *merge_sorted(lo[a:b], hi[a:b], touch)) for a, b in zip(cut, cut[1:])]
                mcode = np.concatenate([np.full(len(x), c) for c, x, _ in parts])
                mlo, mhi = np.concatenate([x for _, x, _ in parts]), np.concatenate([y for _, _, y in parts])
            first = np.flatnonzero(np.r_[True, mcode[1:] != mcode[:-1]])
            row = order[np.searchsorted(codes, mcode[first])]
            flat = np.empty(2 * len(mlo), dtype=np.int64)
            flat[0::2], flat[1::2] = mlo, mhi
            offsets = np.append(first, len(mcode)).astype(np.int32) * 2
            out = [k.take(pa.array(row)) for k in keys]
            out.append(pa.array(np.full(len(first), part, dtype=np.int64)))
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))
            held, rows, part = [], 0, part + 1
            return pa.RecordBatch.from_arrays(out, [*[f"k{i}" for i in range(n_keys)], "part", "spans"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= flush_rows:
                yield flush()
        if rows:
            yield flush()

    return fold


def merge_intervals(
    df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, touch: int = 1, fan_in: int = 64, flush_rows: int = 200_000, drop_null_keys: bool = True,
    tasks: int | None = None,
) -> DataFrame:
    """Per key the sorted disjoint spans of all its closed integer intervals: ``keys..., spans array<bigint>``.

    ``lo`` and ``hi`` are column names or dotted paths of integers.  The tree has as many levels as
    the number of scan tasks asks for; each level merges at most about ``fan_in`` states in a task.  ``tasks`` names that
    number where ``df`` is no plain scan and asking for it would plan its shuffles twice.
    """
    n = len(keys)
    src = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(lo).cast("bigint").alias("a"), F.col(hi).cast("bigint").alias("b")
    ).filter(F.col("a").isNotNull() | F.col("b").isNotNull())
    if drop_null_keys:
        for i in range(n):
            src = src.filter(F.col(f"k{i}").isNotNull())
    src = src.select(
        *[f"k{i}" for i in range(n)],
        F.least("a", "b").alias("lo"),  # least and greatest skip nulls: a missing end takes the other's value
        F.greatest("a", "b").alias("hi"),
    )
    key_fields = [T.StructField(f"k{i}", src.schema[f"k{i}"].dataType) for i in range(n)]
    schema = T.StructType([*key_fields, T.StructField("part", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))])
    tasks = tasks or max(1, src.rdd.getNumPartitions())
    parts = src.mapInArrow(_fold_partition(n, touch, flush_rows), schema).withColumn("part", F.spark_partition_id() + F.col("part") * F.lit(tasks))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def merged(spans: pd.Series) -> np.ndarray:
        return merge_states(list(spans), touch)

    ks = [f"k{i}" for i in range(n)]
    width = tasks
    while width > fan_in:
        width = -(-width // fan_in)
        parts = parts.groupBy(*ks, F.pmod("part", F.lit(width)).alias("part")).agg(merged("spans").alias("spans"))
    out = parts.groupBy(*ks).agg(merged("spans").alias("spans"))
    return out.select(*[F.col(f"k{i}").alias(k.split(".")[-1]) for i, k in enumerate(keys)], "spans")


def spans_and_gaps(merged: DataFrame, *, kind: str = "span_kind", lo: str = "lo", hi: str = "hi", touch: int = 1) -> DataFrame:
    """Rows of a merged state: each 'period', and each 'gap' between two periods, first and last value included.

    Works inside the JVM.  A gap runs from the value after a period to the value before the next one.
    """
    keys = [c for c in merged.columns if c != "spans"]
    n = (F.size("spans") / 2).cast("int")
    row = lambda k, a, b: F.struct(F.lit(k).alias(kind), a.alias(lo), b.alias(hi))
    periods = F.transform(F.sequence(F.lit(0), n - 1), lambda i: row("period", F.get("spans", 2 * i), F.get("spans", 2 * i + 1)))
    gaps = F.when(
        n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: row("gap", F.get("spans", 2 * i + 1) + 1, F.get("spans", 2 * i + 2) - 1))
    ).otherwise(F.expr(f"cast(array() as array<struct<{kind}:string,{lo}:bigint,{hi}:bigint>>)"))
    return merged.filter(F.size("spans") > 0).select(*keys, F.inline(F.concat(periods, gaps)))
