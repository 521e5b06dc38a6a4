"""Joins, unions and deduplication beyond the plain ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.tables import small_enough


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in order.  An aggregation, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in order wins."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return got.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, object], flag: str | None = None) -> DataFrame:
    """Left lookup with a default per column and a flag that tells 'found' from 'default'.

    The dimension is broadcast only where the optimizer proves it small.
    """
    side = dim.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(on.values())], *[F.col(c).alias(f"_t_{c}") for c in take], F.lit(True).alias("_hit"))
    if small_enough(side, 16 << 20):
        side = F.broadcast(side)
    cond = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"_k{i}") for i, a in enumerate(on)])
    out = df.join(side, cond, "left")
    cols = {c: F.coalesce(F.col(f"_t_{c}"), F.lit(v)) for c, v in take.items()}
    if flag:
        cols[flag] = F.when(F.col("_hit"), "found").otherwise("default")
    return out.withColumns(cols).drop("_hit", *[f"_k{i}" for i in range(len(on))], *[f"_t_{c}" for c in take])


def bridge(a: DataFrame, b: DataFrame, c: DataFrame, ab: Sequence[str], bc: Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that reach ``c`` by way of ``b``, rows of ``a`` that don't, with the reason)."""
    first = a.join(b, list(ab), "left_anti").select(key, F.lit("no bridge").alias("reason"))
    mid = a.join(b, list(ab))
    second = mid.join(c, list(bc), "left_anti").select(key, F.lit("no target").alias("reason"))
    return mid.join(c, list(bc)), first.unionByName(second)


def meet(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Inner join of many aligned series on their common keys."""
    return reduce(lambda x, y: x.join(y, list(on)), frames)


def nest(parent: DataFrame, child: DataFrame, key: str, fields: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """Parents with the array of their children in order; no children: an empty array."""
    kids = child.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("_f")))), lambda x: x["_f"]).alias(name))
    return parent.join(kids, key, "left").withColumn(name, F.coalesce(name, F.array()))


def priority_union(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of sources; of rows with one key the one of the earliest source stays."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged), [key], ["_src"]).drop("_src")


def fill_from(df: DataFrame, extra: DataFrame, key: str, fill: Sequence[str] = (), override: Sequence[str] = ()) -> DataFrame:
    """Enrichment: ``fill`` columns only where null, ``override`` columns wherever the other side has a value."""
    cols = [*fill, *override]
    side = extra.select(key, *[F.col(c).alias(f"_x_{c}") for c in cols])
    out = df.join(side, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_x_{c}")) for c in fill} | {c: F.coalesce(F.col(f"_x_{c}"), F.col(c)) for c in override})
    return out.drop(*[f"_x_{c}" for c in cols])


def contains_match(left: DataFrame, right: DataFrame, left_text: str, right_text: str, *, min_token: int = 3) -> DataFrame:
    """Pairs of which one text contains the other as a run of whole words, either way round.

    Candidates share their rarest word, so no pair is tried for nothing: of a contained text every word occurs in the
    containing one, its rarest one included.
    """
    a = left.select(F.col(left_text).alias("lt")).distinct().withColumn("w", F.array_distinct(F.split(F.lower("lt"), r"\W+")))
    b = right.select(F.col(right_text).alias("rt")).distinct().withColumn("w", F.array_distinct(F.split(F.lower("rt"), r"\W+")))
    rows = lambda d, t: d.select(t, F.explode("w").alias("word")).filter(F.col("word") != "")
    ra, rb = rows(a, "lt"), rows(b, "rt")
    freq = ra.select("word").unionAll(rb.select("word")).groupBy("word").agg(F.count("*").alias("f"))
    rare = lambda d, t: d.join(freq, "word").groupBy(t).agg(F.min_by("word", F.struct("f", "word")).alias("word"))
    pairs = rare(ra, "lt").join(rb, "word").select("lt", "rt").unionByName(rare(rb, "rt").join(ra, "word").select("lt", "rt")).distinct()
    pad = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"\W+", " ")), F.lit(" "))
    return pairs.filter(pad("lt").contains(pad("rt")) | pad("rt").contains(pad("lt")))


def cascade(df: DataFrame, key: str, steps: Sequence[tuple[str, DataFrame]], value: str) -> DataFrame:
    """The first step that knows a key decides: ``df`` with ``value`` and ``matched_by`` (null if no step does)."""
    out = df
    for i, (_, table) in enumerate(steps):
        out = out.join(table.select(key, F.col(value).alias(f"_v{i}")), key, "left")
    val = F.coalesce(*[F.col(f"_v{i}") for i in range(len(steps))])
    by = F.coalesce(*[F.when(F.col(f"_v{i}").isNotNull(), F.lit(n)) for i, (n, _) in enumerate(steps)])
    return out.withColumn(value, val).withColumn("matched_by", by).drop(*[f"_v{i}" for i in range(len(steps))])


def update_if_single(df: DataFrame, key: str, updates: DataFrame, update_key: str, value: str) -> DataFrame:
    """``df`` with ``value`` replaced by the update's, but only where exactly one update fits the row."""
    one = updates.groupBy(F.col(update_key).alias(key)).agg(F.count("*").alias("_n"), F.first(value).alias("_u")).filter("_n = 1")
    return df.join(one, key, "left").withColumn(value, F.coalesce("_u", value)).drop("_n", "_u")


def mirrored(df: DataFrame, swap: Sequence[tuple[str, str]], negate: Sequence[str] = (), complement: Sequence[str] = ()) -> DataFrame:
    """``df`` and its mirror image: paired columns change places, differences change sign, shares become 1 - share."""
    new: dict[str, Column] = {}
    for a, b in swap:
        new[a], new[b] = F.col(b), F.col(a)
    new |= {c: -F.col(c) for c in negate} | {c: 1 - F.col(c) for c in complement}
    turned = df.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])
    return df.withColumn("mirrored", F.lit(False)).unionByName(turned.withColumn("mirrored", F.lit(True)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones are 0."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def reorder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns in the given order; a missing one is an error that names it."""
    lost = [c for c in cols if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df.select(*cols)
