"""Ordered events: running states, first crossings, milestones, neighbours, n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut_lineage


def running_max(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"max_{c}": F.max(c).over(w) for c in cols})


def first_crossing(df: DataFrame, by: Sequence[str], order: Sequence[str], sides: dict[str, str], threshold: float, *, tie: str = "order", first: str | None = None) -> DataFrame:
    """The side whose running score first reaches ``threshold``: ``by..., winner``.

    ``sides`` maps a side's name to its (non-decreasing) score column.  Only rows at or above the threshold matter, so
    one aggregation with map-side combine does what a window over all rows would.  Two sides that arrive in one row:
    ``tie='order'`` takes ``first``, ``tie='null'`` gives a null winner.
    """
    pos = F.struct(*order)
    aggs = [F.min(F.when(F.col(c) >= threshold, pos)).alias(f"at_{s}") for s, c in sides.items()]
    out = df.groupBy(*by).agg(*aggs)
    names = list(sides)
    if first:
        names = [first, *[n for n in names if n != first]]
    ats = {n: F.col(f"at_{n}") for n in names}
    known = [a for a in ats.values()]
    earliest = F.least(*known) if len(known) > 1 else known[0]
    winner = F.lit(None).cast("string")
    for n in reversed(names):
        winner = F.when(ats[n] == earliest, n).otherwise(winner)
    if tie == "null":
        hits = sum(F.when(a == earliest, 1).otherwise(0) for a in known)
        winner = F.when(hits == 1, winner)
    return out.filter(earliest.isNotNull()).select(*by, winner.alias("winner"))


def crossing_by_step(df: DataFrame, by: Sequence[str], order: Sequence[str], score: str, points: str, threshold: float) -> Column | DataFrame:
    """First rows at which ``score >= threshold`` and ``score - points < threshold``: ``by...`` and the row's order columns."""
    hit = (F.col(score) >= threshold) & (F.col(score) - F.col(points) < threshold)
    return df.filter(hit).groupBy(*by).agg(F.min(F.struct(*order)).alias("_p")).select(*by, "_p.*")


def milestones(df: DataFrame, by: Sequence[str], order: Sequence[str], score: Column, levels: Sequence[float]) -> DataFrame:
    """The 1-based ordinal among all rows of a key at which the score first reaches each level (null if never)."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = df.withColumn("_n", F.row_number().over(w)).withColumn("_s", score)
    return n.groupBy(*by).agg(*[F.min(F.when(F.col("_s") >= v, F.col("_n"))).alias(f"n_to_{v:g}") for v in levels], F.count("*").alias("n_rows"))


def last_state(df: DataFrame, by: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each key's values in its last row."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_s")).select(*by, "_s.*")


def drop_adjacent_repeats(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (nulls are alike)."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_k", first | ~F.lag(value).over(w).eqNullSafe(F.col(value))).filter("_k").drop("_k")


def token_rows(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    return df.select(key, F.posexplode(tokens).alias("pos", "token"))


def ngrams(df: DataFrame, keys: Sequence[str], tokens: Column, n: int, boundary: str | None = None) -> DataFrame:
    """``keys..., gram array`` for every window of ``n`` tokens of a row.  Windows never leave their row, so no shuffle is needed."""
    t = df.select(*keys, tokens.alias("_t")).filter(F.size("_t") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("_t") - n + 1), lambda i: F.slice("_t", i, n))
    if boundary is not None:
        grams = F.filter(grams, lambda g: ~F.array_contains(g, boundary))
    return t.select(*keys, F.explode(grams).alias("gram"))


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without one task seeing all rows: range partitions are numbered within, and the
    sizes of the partitions before (one number each) are added."""
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    sizes = parts.groupBy("_pid").count().orderBy("_pid").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r["_pid"], at))
        at += r["count"]
    if not before:
        return parts.drop("_pid").withColumn(name, F.lit(None).cast("bigint"))
    offset = df.sparkSession.createDataFrame(before, "_pid int, _off bigint")
    w = Window.partitionBy("_pid").orderBy(*order)
    return parts.join(F.broadcast(offset), "_pid").withColumn(name, F.row_number().over(w) + F.col("_off")).drop("_pid", "_off")


def plateau(df: DataFrame, order: str, value: str, least: float) -> DataFrame:
    """The first step at which the value moves by less than ``least``.  For summaries of a few rows."""
    w = Window.orderBy(order)
    return df.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).filter(F.col("_d") < least).agg(F.min(order).alias("plateau_at"))


def sparkline(df: DataFrame, order: str, value: str, glyphs: str = "▁▂▃▄▅▆▇█") -> DataFrame:
    """Each value's place between the least and the largest as one of the glyphs (the middle one if all are equal)."""
    span = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    at = F.when(F.col("_b") > F.col("_a"), F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * (len(glyphs) - 1) + 0.5)).otherwise(F.lit(len(glyphs) // 2))
    return df.join(F.broadcast(span)).withColumn("level", at.cast("int")).withColumn("glyph", F.substring(F.lit(glyphs), at.cast("int") + 1, F.lit(1))).drop("_a", "_b")
