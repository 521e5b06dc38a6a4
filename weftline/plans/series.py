"""Time-series queries: alignment, lags, skill, baselines, resampling."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import times
from weftline.operators import series as S
from weftline.plans._util import DAILY, daily, hourly_pair, pair_sql, r, rounded, t


@query("hourly_series", "AGG17", "DT01", sql="""
SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(avg(value), 9) AS mean_value, round(sum(value), 4) AS total
FROM events GROUP BY ALL""")  # fmt: skip
def hourly_series(spark: SparkSession, d: str) -> DataFrame:
    b = S.bucket(t(spark, d, "events"), "ts", "hour", ["event_type"], F.count("*").alias("n"), r(F.avg("value"), 9).alias("mean_value"), r(F.sum("value"), 4).alias("total"))
    return b.select(F.col("bucket").cast("timestamp_ntz").alias("hour"), "event_type", "n", "mean_value", "total")


@query("coverage_mean", "AGG08", "FIL06", "JON08", sql=f"""
WITH {DAILY} SELECT day, round(avg(v), 6) AS mean_value FROM daily GROUP BY day HAVING count(DISTINCT event_type) = 5""")  # fmt: skip
def coverage_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.covered_mean(daily(spark, d), "day", "event_type", "v", 5))


@query("lag_features", "JON09", "PRJ05", "DT02", "DT04", "DT17", "MTH13", "MTH14", "PRJ08", sql=f"""
WITH {DAILY}, s AS (SELECT day, avg(v) AS y FROM daily GROUP BY day HAVING count(DISTINCT event_type) = 5)
SELECT s.day, round(s.y, 6) AS y, round(a.y, 6) AS lag_1d, round(b.y, 6) AS lag_7d, (isodow(s.day) - 1)::INTEGER AS dow,
  CASE WHEN isodow(s.day) >= 6 THEN 1 ELSE 0 END AS weekend, round(sin((isodow(s.day) - 1) * 2 * 3.141592653589793 / 7), 6) AS dow_sin,
  round(cos((isodow(s.day) - 1) * 2 * 3.141592653589793 / 7), 6) AS dow_cos, round(greatest(s.y - 50, 0), 6) AS above, round(greatest(50 - s.y, 0), 6) AS below
FROM s JOIN s a ON a.day = s.day - INTERVAL 1 DAY JOIN s b ON b.day = s.day - INTERVAL 7 DAY""")  # fmt: skip
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    s = S.covered_mean(daily(spark, d), "day", "event_type", "v", 5).withColumnRenamed("mean_value", "y")
    f = S.with_lags(s, "day", "y", {"lag_1d": "1 day", "lag_7d": "7 days"})
    dow = F.weekday("day")
    sin, cos = times.cycle(dow, 7)
    return rounded(f.select("day", "y", "lag_1d", "lag_7d", dow.alias("dow"), times.is_weekend(F.col("day")).alias("weekend"), sin.alias("dow_sin"), cos.alias("dow_cos"),
                            F.greatest(F.col("y") - 50, F.lit(0.0)).alias("above"), F.greatest(50 - F.col("y"), F.lit(0.0)).alias("below")))


@query("skill_scores", "AGG10", "AGG11", "JON07", sql=f"""
WITH {DAILY}, p AS (SELECT a.event_type, a.v AS y, b.v AS f FROM daily a JOIN daily b ON a.event_type = b.event_type AND b.day = a.day - INTERVAL 1 DAY)
SELECT event_type, count(*) AS n, round(avg(f - y), 6) AS bias, round(avg(abs(f - y)), 6) AS mae, round(sqrt(avg((f - y) * (f - y))), 6) AS rmse,
  round(corr(y, f), 6) AS r, round(100 * avg(abs((f - y) / y)), 6) AS mape, round(1 - avg((f - y) * (f - y)) / var_pop(y), 6) AS r2
FROM p GROUP BY event_type""")  # fmt: skip
def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    p = S.with_lags(daily(spark, d), "day", "v", {"f": "1 day"}, ["event_type"])
    return rounded(p.groupBy("event_type").agg(*S.skill(F.col("v"), F.col("f"))))


_SPLIT = "TIMESTAMP '2024-01-22'"


@query("persistence_vs_climatology", "ML04", sql=f"""
WITH {pair_sql('view', 'click')}, h AS (SELECT ts, a AS y, hour(ts) AS h, month(ts) AS m FROM pair),
clim AS (SELECT h, m, avg(y) AS c FROM h WHERE ts < {_SPLIT} GROUP BY ALL), o AS (SELECT avg(y) AS o FROM h WHERE ts < {_SPLIT})
SELECT h.ts, round(h.y, 6) AS y, round(p.y, 6) AS persistence, round(coalesce(c, o.o), 6) AS climatology
FROM h LEFT JOIN clim USING (h, m) LEFT JOIN h p ON p.ts = h.ts - INTERVAL 24 HOUR, o WHERE h.ts >= {_SPLIT}""")  # fmt: skip
def persistence_vs_climatology(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_pair(spark, d, "view", "click").select("ts", F.col("a").alias("y"))
    return rounded(S.seasonal_baselines(h, "ts", "y", F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")))


@query("diurnal_profile", "AGG09", "DT03", "AGG07", "AGG16", "STR15", sql="""
SELECT ((hour(ts) - 8 + 24) % 24)::INTEGER AS local_hour, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS sd,
  round(min(value), 6) AS lo, round(median(value), 6) AS p50, round(max(value), 6) AS hi, round(100.0 * count(CASE WHEN value > 10 THEN value END) / count(*), 6) AS pct_valid
FROM events GROUP BY ALL""")  # fmt: skip
def diurnal_profile(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return rounded(
        t(spark, d, "events").groupBy(times.local_hour(F.col("ts"), -8).alias("local_hour"), "event_type")
        .agg(F.count("*").alias("n"), F.avg(v).alias("mean_value"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.median(v).alias("p50"), F.max(v).alias("hi"),
             (100.0 * F.count(F.when(v > 10, v)) / F.count("*")).alias("pct_valid"))
    )


@query("response_curve_bins", "AGG12", "FIL05", "FIL02", sql="""
SELECT floor(l_quantity / 5)::BIGINT AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_y, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90
FROM lineitem GROUP BY 1 HAVING count(*) >= 20""")  # fmt: skip
def response_curve_bins(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.equal_width_bins(t(spark, d, "lineitem").select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", 5.0, 20), 4)


@query("degree_slope", "MTH14", "INF13", "AGG40", sql=f"""
WITH {DAILY}, s AS (SELECT day, avg(CASE WHEN event_type = 'view' THEN v END) AS x, avg(CASE WHEN event_type = 'click' THEN v END) AS y FROM daily GROUP BY day),
b AS (SELECT isodow(day) AS k, avg(y) AS m FROM s GROUP BY 1)
SELECT round(regr_slope(y, greatest(x - 50, 0)), 6) AS slope_above, round(regr_slope(y, greatest(50 - x, 0)), 6) AS slope_below,
  (SELECT (arg_min(k, m) - 1)::INTEGER FROM b) AS low_dow, (SELECT (arg_max(k, m) - 1)::INTEGER FROM b) AS high_dow
FROM s WHERE x IS NOT NULL AND y IS NOT NULL""")  # fmt: skip
def degree_slope(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d).groupBy("day").agg(F.avg(F.when(F.col("event_type") == "view", F.col("v"))).alias("x"), F.avg(F.when(F.col("event_type") == "click", F.col("v"))).alias("y"))
    fit = s.filter("x is not null and y is not null").agg(
        r(F.regr_slope("y", F.greatest(F.col("x") - 50, F.lit(0.0)))).alias("slope_above"), r(F.regr_slope("y", F.greatest(50 - F.col("x"), F.lit(0.0)))).alias("slope_below")
    )
    ends = s.groupBy(F.weekday("day").alias("k")).agg(F.avg("y").alias("m")).agg(F.min_by("k", "m").alias("low_dow"), F.max_by("k", "m").alias("high_dow"))
    return fit.join(F.broadcast(ends))


@query("net_error_by_hour", "AGG13", "AGG42", "MTH01", sql=f"""
WITH {pair_sql('view', 'purchase')}, h AS (SELECT ((hour(ts) - 7 + 24) % 24)::INTEGER AS local_hour, a - b AS e, abs(a) AS g, abs(a - b) AS n FROM pair),
k AS (SELECT local_hour, count(*) AS n, round(avg(e), 6) AS mean_error, round(stddev_pop(e), 6) AS sd_error, round(avg(g), 6) AS gross, round(avg(n), 6) AS net,
  avg(n) > avg(g) AS net_worse FROM h GROUP BY 1)
SELECT *, round((SELECT avg(mean_error) FROM k WHERE local_hour BETWEEN 17 AND 21), 5) AS evening_mean FROM k""")  # fmt: skip
def net_error_by_hour(spark: SparkSession, d: str) -> DataFrame:
    h = hourly_pair(spark, d, "view", "purchase").select(times.local_hour(F.col("ts"), -7).alias("local_hour"), (F.col("a") - F.col("b")).alias("e"), F.abs("a").alias("g"))
    k = h.groupBy("local_hour").agg(
        F.count("*").alias("n"), r(F.avg("e")).alias("mean_error"), r(F.stddev_pop("e")).alias("sd_error"), r(F.avg("g")).alias("gross"), r(F.avg(F.abs("e"))).alias("net"),
        (F.avg(F.abs("e")) > F.avg("g")).alias("net_worse"),
    )
    evening = k.filter(F.col("local_hour").between(17, 21)).agg(r(F.avg("mean_error"), 5).alias("evening_mean"))
    return k.join(F.broadcast(evening))


@query("surprise_spread_corr", "AGG14", "INF12", sql=f"""
WITH {pair_sql('view', 'click')}, h AS (SELECT CASE WHEN ((hour(ts) - 8 + 24) % 24) BETWEEN 17 AND 21 THEN 'ramp' ELSE 'rest' END AS part, a, b FROM pair)
SELECT part, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN round(corr(a, b), 6) END AS r,
  round(avg(CASE WHEN sign(a - 50) = sign(b - 50) THEN 1.0 ELSE 0.0 END), 6) AS sign_agreement, round(avg(abs(a - b)), 6) AS mean_spread
FROM h GROUP BY part""")  # fmt: skip
def surprise_spread_corr(spark: SparkSession, d: str) -> DataFrame:
    part = F.when(times.local_hour(F.col("ts"), -8).between(17, 21), "ramp").otherwise("rest")
    ok = F.count("*") >= 5
    return rounded(
        hourly_pair(spark, d, "view", "click").groupBy(part.alias("part")).agg(
            F.count("*").alias("n"), F.when(ok, S.correlation(F.col("a"), F.col("b"))).alias("r"),
            F.avg(F.when(F.signum(F.col("a") - 50) == F.signum(F.col("b") - 50), 1.0).otherwise(0.0)).alias("sign_agreement"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_spread"))
    )


def _quintiles(spark: SparkSession, d: str, lo: int, hi: int) -> DataFrame:
    h = hourly_pair(spark, d, "view", "click").filter(times.local_hour(F.col("ts"), -8).between(lo, hi)).withColumn("s", F.col("a") - F.col("b"))
    g = S.quantile_groups(h, [F.col("s"), F.col("ts")], 5, "quintile")
    return rounded(g.groupBy("quintile").agg(F.count("*").alias("n"), F.avg("s").alias("mean_surprise"), F.avg("b").alias("mean_b")))


def _quintile_sql(lo: int, hi: int) -> str:
    return f"""WITH {pair_sql('view', 'click')}, h AS (SELECT *, a - b AS s FROM pair WHERE ((hour(ts) - 8 + 24) % 24) BETWEEN {lo} AND {hi}),
g AS (SELECT *, ntile(5) OVER (ORDER BY s, ts)::INTEGER AS quintile FROM h)
SELECT quintile, count(*) AS n, round(avg(s), 6) AS mean_surprise, round(avg(b), 6) AS mean_b FROM g GROUP BY 1"""


@query("surprise_quintiles", "WIN12", sql=_quintile_sql(17, 21))
def surprise_quintiles(spark: SparkSession, d: str) -> DataFrame:
    return _quintiles(spark, d, 17, 21)


@query("placebo_quintiles", "WIN13", sql=_quintile_sql(0, 5))
def placebo_quintiles(spark: SparkSession, d: str) -> DataFrame:
    return _quintiles(spark, d, 0, 5)


@query("oracle_pnl", "MTH15", "JON06", sql=f"""
WITH {pair_sql('view', 'click')} SELECT hour(ts)::INTEGER AS hour_of_day, count(*) AS n, round(avg(sign(a - 50) * (b - 50)), 6) AS pnl, round(avg(abs(b - 50) - 1), 6) AS bound,
  round(avg(CASE WHEN sign(a - 50) * (b - 50) > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM pair GROUP BY 1""")  # fmt: skip
def oracle_pnl(spark: SparkSession, d: str) -> DataFrame:
    pnl = F.signum(F.col("a") - 50) * (F.col("b") - 50)
    return rounded(
        hourly_pair(spark, d, "view", "click").groupBy(F.hour("ts").alias("hour_of_day"))
        .agg(F.count("*").alias("n"), F.avg(pnl).alias("pnl"), F.avg(F.abs(F.col("b") - 50) - 1).alias("bound"), F.avg(F.when(pnl > 0, 1.0).otherwise(0.0)).alias("win_rate"))
    )


@query("gate_buckets", "AGG15", "DQ03", "DT15", sql=f"""
WITH {pair_sql('view', 'click')}, b(bucket, lo, hi) AS (VALUES ('all', 0, 23), ('morning', 6, 11), ('evening', 17, 21), ('clean', 10, 23)),
h AS (SELECT hour(ts) AS h, abs((b - a) / b) AS ape FROM pair WHERE b <> 0)
SELECT bucket, count(*) AS n, round(100 * avg(ape), 5) AS mape, bool_or(h.h < 10) AS leaks FROM h JOIN b ON h.h BETWEEN lo AND hi GROUP BY 1""")  # fmt: skip
def gate_buckets(spark: SparkSession, d: str) -> DataFrame:
    b = spark.createDataFrame([("all", 0, 23), ("morning", 6, 11), ("evening", 17, 21), ("clean", 10, 23)], "bucket string, lo int, hi int")
    h = hourly_pair(spark, d, "view", "click").filter("b <> 0").select(F.hour("ts").alias("h"), F.abs((F.col("b") - F.col("a")) / F.col("b")).alias("ape"))
    # hours are few: the buckets are joined to sums per hour and not to rows
    per = h.groupBy("h").agg(F.count("*").alias("k"), F.sum("ape").alias("s"))
    j = per.join(F.broadcast(b), F.col("h").between(F.col("lo"), F.col("hi")))
    return j.groupBy("bucket").agg(F.sum("k").alias("n"), r(100 * F.sum("s") / F.sum("k"), 5).alias("mape"), F.bool_or(F.col("h") < 10).alias("leaks"))


@query("rolling_folds", "WIN20", "AGG38", sql=f"""
WITH {DAILY}, s AS (SELECT day, avg(v) AS y FROM daily GROUP BY day), n AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS rn, count(*) OVER () AS n FROM s),
p AS (SELECT *, floor(n * 0.5)::BIGINT AS f, (n - floor(n * 0.5)::BIGINT) // 4 AS z FROM n), k(fold) AS (VALUES (0), (1), (2), (3)),
q AS (SELECT fold, CASE WHEN rn < f + fold * z THEN 'train' ELSE 'test' END AS part, y FROM p JOIN k ON rn < f + (fold + 1) * z)
SELECT fold, part, count(*) AS n, round(avg(y), 6) AS mean_y, round(stddev_pop(y), 6) AS sd_y FROM q GROUP BY ALL""")  # fmt: skip
def rolling_folds(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d).groupBy("day").agg(F.avg("v").alias("y"))
    f = S.expanding_folds(s, "day", 4, 0.5)
    return rounded(f.groupBy("fold", "part").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("sd_y")))


@query("time_split", "WIN19", sql=f"""
WITH {DAILY}, s AS (SELECT day, avg(v) AS y FROM daily GROUP BY day), n AS (SELECT *, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM s)
SELECT day, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part FROM n""")  # fmt: skip
def time_split(spark: SparkSession, d: str) -> DataFrame:
    s = daily(spark, d).select("day").distinct()
    w = Window.orderBy("day")  # one row a day
    n = F.count("*").over(Window.partitionBy())
    return s.select("day", F.when(F.row_number().over(w) <= F.floor(n * 0.8), "train").otherwise("test").alias("part"))


_MONTHS = "m AS (SELECT last_day(o_orderdate)::DATE AS month_end, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders GROUP BY 1)"


def _months(spark: SparkSession, d: str) -> DataFrame:
    return S.month_last(t(spark, d, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), "o_orderdate", "o_orderkey", "o_totalprice").withColumnRenamed("o_totalprice", "v")


@query("month_end_resample", "AGG20", sql=f"""
WITH {_MONTHS}, s AS (SELECT last_day(unnest(generate_series(date_trunc('month', (SELECT min(month_end) FROM m)), (SELECT max(month_end) FROM m)::TIMESTAMP, INTERVAL 1 MONTH)))::DATE AS month_end)
SELECT month_end, round(v, 6) AS v FROM s LEFT JOIN m USING (month_end)""")  # fmt: skip
def month_end_resample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_months(spark, d))


@query("mom_change", "WIN08", "WIN11", "WIN10", sql=f"""
WITH {_MONTHS}, c AS (SELECT month_end, v, v - lag(v) OVER w AS diff_1, 100 * (v - lag(v) OVER w) / lag(v) OVER w AS pct_1, v - lag(v, 12) OVER w AS diff_12,
  100 * (v - lag(v, 12) OVER w) / lag(v, 12) OVER w AS pct_12, row_number() OVER (ORDER BY month_end DESC) AS back FROM m WINDOW w AS (ORDER BY month_end))
SELECT month_end, round(v, 4) AS v, round(diff_1, 4) AS diff_1, round(pct_1, 4) AS pct_1, round(diff_12, 4) AS diff_12, round(pct_12, 4) AS pct_12 FROM c WHERE back <= 24""")  # fmt: skip
def mom_change(spark: SparkSession, d: str) -> DataFrame:
    c = S.change(_months(spark, d), "month_end", "v")
    back = F.row_number().over(Window.orderBy(F.col("month_end").desc()))  # one row a month
    return rounded(c.withColumn("back", back).filter("back <= 24").drop("back"), 4)


@query("yoy_asof", "JON10", "DT11", "EXT03", sql="""
WITH m AS (SELECT o_custkey AS k, o_orderdate AS ts, o_totalprice AS v, o_orderkey AS o FROM orders)
SELECT a.k, a.o, round(a.v, 4) AS v, round((SELECT b.v FROM m b WHERE b.k = a.k AND b.ts <= a.ts - INTERVAL 1 YEAR ORDER BY b.ts DESC, b.o DESC LIMIT 1), 4) AS year_ago FROM m a""")  # fmt: skip
def yoy_asof(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("o"))
    one = m.groupBy("k", "ts").agg(F.max_by("v", "o").alias("v"))
    left = m.select("k", "o", "v", (F.col("ts") - F.expr("interval 1 year")).alias("ts"))
    return rounded(S.asof(left, one.withColumnRenamed("v", "year_ago"), ["k"], "ts", "year_ago").select("k", "o", "v", F.col("asof_year_ago").alias("year_ago")), 4)


@query("decline_streaks", "WIN09", sql=f"""
WITH {_MONTHS}, a AS (SELECT *, v - lag(v) OVER (ORDER BY month_end) AS dv FROM m),
b AS (SELECT *, sum(CASE WHEN dv < 0 THEN 0 ELSE 1 END) OVER (ORDER BY month_end ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT count(*) AS length, min(month_end) AS first_at, max(month_end) AS last_at, round(sum(dv), 4) AS total_change FROM b WHERE dv < 0 GROUP BY g""")  # fmt: skip
def decline_streaks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.streaks(_months(spark, d), "month_end", "v"), 4)


@query("monthly_spine", "JON12", "DT09", sql="""
WITH s AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH))::DATE AS month),
u AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
f AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS open_price FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
l AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, avg(l_discount) AS discount FROM lineitem GROUP BY 1)
SELECT month, round(urgent, 4) AS urgent, round(open_price, 4) AS open_price, round(discount, 6) AS discount FROM s LEFT JOIN u USING (month) LEFT JOIN f USING (month) LEFT JOIN l USING (month)""")  # fmt: skip
def monthly_spine(spark: SparkSession, d: str) -> DataFrame:
    spine = spark.range(1).select(F.explode(times.last_months(F.lit("1996-12-15").cast("date"), 24)).alias("month"))
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    month = lambda c: F.trunc(c, "month").alias("month")
    u = o.filter("o_orderpriority = '1-URGENT'").groupBy(month("o_orderdate")).agg(r(F.avg("o_totalprice"), 4).alias("urgent"))
    f = o.filter("o_orderstatus = 'O'").groupBy(month("o_orderdate")).agg(r(F.avg("o_totalprice"), 4).alias("open_price"))
    s = li.groupBy(month("l_shipdate")).agg(r(F.avg("l_discount")).alias("discount"))
    return spine.join(u, "month", "left").join(f, "month", "left").join(s, "month", "left")


@query("yoy_same_period", "JON11", sql="""
WITH m AS (SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS p, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT a.y, a.p, round(a.v, 4) AS v, round(a.v - b.v, 4) AS yoy FROM m a JOIN m b ON b.y = a.y - 1 AND b.p = a.p""")  # fmt: skip
def yoy_same_period(spark: SparkSession, d: str) -> DataFrame:
    m = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("p")).agg(F.avg("o_totalprice").alias("v"))
    past = m.select((F.col("y") + 1).alias("y"), "p", F.col("v").alias("w"))
    return rounded(m.join(past, ["y", "p"]).select("y", "p", "v", (F.col("v") - F.col("w")).alias("yoy")), 4)


@query("trend_first_last", "WIN21", "WIN26", sql=f"""
WITH {_MONTHS}, e AS (SELECT arg_min(v, month_end) AS f, arg_max(v, month_end) AS l, min(v) AS a, max(v) AS b FROM m), q AS (SELECT *, row_number() OVER (ORDER BY month_end DESC) AS back FROM m)
SELECT month_end, floor((v - a) / (b - a) * 7 + 0.5)::INTEGER AS level, substr('▁▂▃▄▅▆▇█', floor((v - a) / (b - a) * 7 + 0.5)::INTEGER + 1, 1) AS glyph, round(l - f, 4) AS delta
FROM q, e WHERE back <= 40""")  # fmt: skip
def trend_first_last(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.sequences import sparkline

    m = _months(spark, d).filter("v is not null")
    ends = m.agg(r(F.max_by("v", "month_end") - F.min_by("v", "month_end"), 4).alias("delta"))
    back = F.row_number().over(Window.orderBy(F.col("month_end").desc()))  # one row a month
    return sparkline(m, "month_end", "v").withColumn("back", back).filter("back <= 40").join(F.broadcast(ends)).select("month_end", "level", "glyph", "delta")


@query("rate_budget", "WIN23", "STM08", sql="""
SELECT event_id, round(sum(value) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW), 4) AS spent FROM events""")  # fmt: skip
def rate_budget(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "ts", "value")
    return S.budget_load(e, "ts", "value", 3600).select("event_id", r("spent", 4).alias("spent"))


@query("trailing_days", "WIN24", "DT07", "DT08", sql="""
WITH s AS (SELECT unnest(generate_series(DATE '2024-01-28' - 2, DATE '2024-01-28', INTERVAL 1 DAY))::DATE AS day)
SELECT day, (SELECT count(*) FROM events WHERE ts::DATE = day) AS n FROM s""")  # fmt: skip
def trailing_days(spark: SparkSession, d: str) -> DataFrame:
    today = F.lit("2024-01-28").cast("date")
    spine = spark.range(1).select(F.explode(F.sequence(F.date_sub(today, 2), today)).alias("day"))
    n = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("month_chunks", "DT05", "DT06", sql="""
WITH g AS (SELECT o_orderpriority AS k, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
m AS (SELECT k, a, b, unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH))::DATE AS m FROM g)
SELECT k, strftime(m, '%Y-%m') AS month, greatest(m, a) AS first_day, least(last_day(m), b) AS last_day FROM m""")  # fmt: skip
def month_chunks(spark: SparkSession, d: str) -> DataFrame:
    g = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return g.select("k", F.inline(times.month_chunks(F.col("a"), F.col("b"))))


@query("day_chunks", "DT06", sql="""
SELECT f::DATE AS first_day, least(f::DATE + 30, DATE '2024-03-15') AS next_day FROM (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-03-14', INTERVAL 30 DAY)) AS f)""")  # fmt: skip
def day_chunks(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.inline(times.day_chunks(F.lit("2024-01-10").cast("date"), F.lit("2024-03-15").cast("date"), 30)))
