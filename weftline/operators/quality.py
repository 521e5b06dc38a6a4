"""Audits of captured data: gaps, manifests, firewalls between roles, leakage, planning."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expected_grid(spans: DataFrame, at: str, unit: str, members: DataFrame) -> DataFrame:
    """Every time of the span with every member.  The grid is what has to exist, so it is as large as the data at most."""
    span = spans.agg(F.min(at).alias("__a"), F.max(at).alias("__b"))  # one row
    times = F.sequence(F.date_trunc(unit, "__a"), F.date_trunc(unit, "__b"), F.expr(f"interval 1 {unit}"))
    return members.distinct().join(F.broadcast(span)).select(F.explode(times).alias(at), *members.columns)


def gaps(expected: DataFrame, actual: DataFrame, on: Sequence[str]) -> DataFrame:
    return expected.join(actual.select(*on).distinct(), list(on), "left_anti")


def rollup(entries: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    return entries.groupBy(*by).agg(
        F.count("*").alias("n_expected"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.bool_and(ok).alias("complete")
    )


def late(event: Column, processed: Column) -> Column:
    """Late rows are labelled, never dropped: true if processed on a later day than the event's."""
    return F.coalesce(F.to_date(processed) != F.to_date(event), F.lit(False))


def firewall(files: DataFrame, path: str, roles: DataFrame, source: str, role: str) -> DataFrame:
    """Files whose tree says another role than their source's configuration, or whose source is unknown.

    Paths look like ``<role>/<source>/...``.
    """
    f = files.select(F.col(path).alias("path"), F.split_part(F.col(path), F.lit("/"), F.lit(1)).alias("tree"), F.split_part(F.col(path), F.lit("/"), F.lit(2)).alias("src"))
    r = roles.select(F.col(source).alias("src"), F.col(role).alias("role"))
    j = f.join(r, "src", "left")
    return j.filter(F.col("role").isNull() | (F.col("role") != F.col("tree"))).select(
        "path", F.when(F.col("role").isNull(), "unknown source").otherwise("wrong tree").alias("problem")
    )


def mixed_provenance(df: DataFrame, by: Sequence[str], provenance: str) -> DataFrame:
    """Groups in which values of more than one provenance were put together."""
    return df.groupBy(*by).agg(F.countDistinct(provenance).alias("n_provenances")).filter("n_provenances > 1")


def leaking(issued: Column, gate: Column) -> Column:
    return F.coalesce(issued > gate, F.lit(True))


def file_problems(files: DataFrame) -> DataFrame:
    """``(path, problem)`` of a ``binaryFile`` table; null where a gzip-ed JSON file is usable.  The whole file is unpacked.

    Spark's reader does not list files without bytes; the list of expected files shows those as missing.
    """

    def judge(body: bytes | None) -> str | None:
        if not body:
            return "empty"
        if body[:2] != b"\x1f\x8b":
            return "not gzip"
        try:
            text = gzip.decompress(body)
        except Exception:
            return "damaged"
        try:
            json.loads(text)
        except Exception:
            return "no JSON"
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "problem": [judge(x) for x in b["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, problem string")


def gate(expected: DataFrame, found: DataFrame, key: str, problem: str) -> DataFrame:
    """``(key, problem)`` of every expected file, those that are not there as 'missing', and a last row 'gate': 'closed' if any
    has a problem, else null."""
    judged = expected.select(key).join(found.withColumn("_there", F.lit(True)), key, "left").select(key, F.when(F.col("_there"), F.col(problem)).otherwise("missing").alias(problem))
    verdict = judged.agg(F.when(F.count(problem) > 0, "closed").alias(problem)).select(F.lit("gate").alias(key), problem)
    return judged.unionByName(verdict)


def heal(have: DataFrame, source: DataFrame, keys: Sequence[str], day: str, last, days: int) -> DataFrame:
    """The trailing window of ``days`` up to ``last``: rows there are, and those of ``source`` whose key is missing, marked ``healed``."""
    window = (F.col(day) > F.date_sub(F.lit(last), days)) & (F.col(day) <= F.lit(last))
    kept = have.filter(window)
    fetched = source.filter(window).join(kept.select(*keys), list(keys), "left_anti")
    return kept.withColumn("healed", F.lit(False)).unionByName(fetched.select(*kept.columns).withColumn("healed", F.lit(True)))


def repair(manifest: DataFrame, disk: DataFrame, key: str, status: str) -> DataFrame:
    """The manifest brought in line with the disk: files there are 'ok', entries without a file 'missing'."""
    m, d = manifest.select(key, F.col(status).alias("_s")), disk.select(key, F.lit(True).alias("_d"))
    return m.join(d, key, "full_outer").select(key, F.when(F.col("_d"), "ok").otherwise("missing").alias(status), (~F.col("_s").eqNullSafe(F.when(F.col("_d"), "ok").otherwise("missing"))).alias("changed"))


def plan(chunks: DataFrame, usable: DataFrame, on: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """What a run can still fetch: chunks without a usable file, in order, until the budget is spent.

    Numbers the missing chunks in one task: they are units of work of a run, a few thousand at most.
    """
    todo = chunks.join(usable.select(*on).distinct(), list(on), "left_anti")
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return todo.withColumn("spent", F.sum(cost).over(w)).filter(F.col("spent") <= budget)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    lost = [c for c in cols if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def not_blank(df: DataFrame, col: str) -> DataFrame:
    """``df``; evaluating it fails on the first row whose value is null or blank."""
    bad = F.col(col).isNull() | (F.trim(F.col(col)) == "")
    return df.withColumn(col, F.when(bad, F.raise_error(F.concat(F.lit(f"{col} is blank"))).cast("string")).otherwise(F.col(col)))
