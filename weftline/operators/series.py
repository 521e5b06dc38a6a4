"""Time series as rows: alignment, resampling, lags by time, seasonal baselines, skill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(df: DataFrame, ts: str, unit: str, by: Sequence[str], *aggs: Column) -> DataFrame:
    """Aggregates per time bucket (``date_trunc`` unit) and further keys; partial aggregation runs before the shuffle."""
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket"), *by).agg(*aggs)


def covered_mean(df: DataFrame, at: str, member: str, value: str, members: int) -> DataFrame:
    """Mean over members at each time at which all ``members`` have a value."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(at)
        .agg(F.avg(value).alias("mean_value"), F.countDistinct(member).alias("n_members"))
        .filter(F.col("n_members") == members)
        .select(at, "mean_value")
    )


def with_lags(df: DataFrame, at: str, value: str, lags: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """The value as it stood each interval earlier, by time and not by position; rows that lack one of them are dropped."""
    out = df
    for name, interval in lags.items():
        past = df.select(*by, (F.col(at) + F.expr(f"interval {interval}")).alias(at), F.col(value).alias(name)).filter(F.col(name).isNotNull())
        out = out.join(past, [at, *by])
    return out


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str, *, strict: bool = False) -> DataFrame:
    """Each left row with the last right value at or before its time (before it, if ``strict``).

    Both sides are laid on one time line per key and the last value is carried forward: one shuffle, no inequality join.
    """
    cols = left.columns
    a = left.select(*cols, F.lit(1 if not strict else 0).alias("_o"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    pads = [F.col(c) if c in [*by, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols]
    b = right.select(*pads, F.lit(0 if not strict else 1).alias("_o"), F.col(value).alias("_v"))
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col("_o")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.withColumn("_l", F.lit(True)).unionByName(b.withColumn("_l", F.lit(False)))
    return both.withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).filter("_l").select(*cols, f"asof_{value}")


def month_last(df: DataFrame, at: str, tie: str, value: str) -> DataFrame:
    """The last value of each month, empty months included as nulls."""
    got = df.groupBy(F.trunc(F.col(at), "month").alias("month")).agg(F.max_by(value, F.struct(at, tie)).alias(value))
    spine = got.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return spine.join(got, "month", "left").select(F.last_day("month").alias("month_end"), value)


def change(df: DataFrame, order: str, value: str, steps: Sequence[int] = (1, 12)) -> DataFrame:
    """Differences and percentage changes against earlier rows.  Meant for resampled series, which are short."""
    w = Window.orderBy(order)
    for k in steps:
        past = F.lag(value, k).over(w)
        df = df.withColumn(f"diff_{k}", F.col(value) - past).withColumn(f"pct_{k}", F.when(past != 0, 100 * (F.col(value) - past) / past))
    return df


def streaks(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Runs of consecutive falls: one row per run with its length, first and last position and total fall."""
    w = Window.partitionBy(*by).orderBy(order)
    step = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_f", (F.col("_d") < 0).cast("int"))
    runs = step.withColumn("_g", F.sum(1 - F.coalesce("_f", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        runs.filter("_f = 1").groupBy(*by, "_g").agg(F.count("*").alias("length"), F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.sum("_d").alias("total_change"))
    ).drop("_g")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary (``corr`` divides by zero there under ANSI rules)."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def skill(actual: Column, predicted: Column) -> list[Column]:
    """Aggregates of forecast skill; pairs with a missing side are left out.  Undefined ratios are null."""
    ok = actual.isNotNull() & predicted.isNotNull()
    a, p = F.when(ok, actual), F.when(ok, predicted)
    e = p - a
    return [
        F.count(e).alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        correlation(a, p).alias("r"), (100 * F.avg(F.when(a != 0, F.abs(e / a)))).alias("mape"),
        F.when(F.var_pop(a) > 0, 1 - F.avg(e * e) / F.var_pop(a)).alias("r2"),
    ]


def equal_width_bins(df: DataFrame, x: str, y: str, width: float, least: int, *, low: float | None = None) -> DataFrame:
    """Mean, 10th and 90th percentile of ``y`` per bin of ``x``, bins with fewer than ``least`` rows left out."""
    start = F.lit(low) if low is not None else F.lit(0.0)
    b = F.floor((F.col(x) - start) / width)
    return (
        df.groupBy(b.cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.percentile(y, F.lit(0.1)).alias("p10"), F.percentile(y, F.lit(0.9)).alias("p90"))
        .filter(F.col("n") >= least)
    )


def quantile_groups(df: DataFrame, by: Sequence[Column], n: int, name: str = "grp") -> DataFrame:
    """Rows cut into ``n`` groups as equal as can be, the first ones larger.  Meant for aligned series, which are short."""
    return df.withColumn(name, F.ntile(n).over(Window.orderBy(*by)))


def seasonal_baselines(df: DataFrame, at: str, value: str, train: Column, persistence: str = "24 hours") -> DataFrame:
    """Test rows with two baselines: the value one interval earlier, and the training mean of the same hour and month
    (the overall training mean where there is none)."""
    keyed = df.withColumn("_h", F.hour(at)).withColumn("_m", F.month(at)).withColumn("_train", train)
    clim = keyed.filter("_train").groupBy("_h", "_m").agg(F.avg(value).alias("_c"))
    overall = keyed.filter("_train").agg(F.avg(value).alias("_o"))
    past = df.select((F.col(at) + F.expr(f"interval {persistence}")).alias(at), F.col(value).alias("persistence"))
    return (
        keyed.filter("not _train").join(F.broadcast(clim), ["_h", "_m"], "left").join(past, at, "left").join(F.broadcast(overall))
        .withColumn("climatology", F.coalesce("_c", "_o")).select(at, value, "persistence", "climatology")
    )


def expanding_folds(df: DataFrame, order: str, folds: int, start_share: float) -> DataFrame:
    """Rows of rolling-origin folds: ``fold``, ``part`` ('train' or 'test').  Fold k trains on all rows before its test block.

    Numbers rows of an aligned series in one task; a row of such a series stands for an hour or a day.
    """
    n = df.count()
    first = int(n * start_share)
    size = (n - first) // folds
    numbered = df.withColumn("_rn", F.row_number().over(Window.orderBy(order)) - 1)
    bounds = df.sparkSession.createDataFrame([(k, first + k * size, first + (k + 1) * size) for k in range(folds)], "fold int, a int, b int")
    part = F.when(F.col("_rn") < F.col("a"), "train").otherwise("test")
    return numbered.join(F.broadcast(bounds), F.col("_rn") < F.col("b")).withColumn("part", part).drop("_rn", "a", "b")


def budget_load(df: DataFrame, ts: str, units: str, seconds: int) -> DataFrame:
    """The units spent in the ``seconds`` up to each call, per minute-sized block so that no task sees the whole log.

    A call needs the calls of its own and the block before it only, so blocks are windows of their own.
    """
    sec = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    base = df.withColumn("_us", sec).withColumn("_b", F.floor(F.col("_us") / size)).withColumn("_own", F.lit(True))
    spill = base.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy("_b").orderBy("_us").rangeBetween(-(size - 1), 0)
    return base.unionByName(spill).withColumn("spent", F.sum(units).over(w)).filter("_own").drop("_us", "_b", "_own")
