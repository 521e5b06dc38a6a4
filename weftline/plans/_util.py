"""Helpers of the query modules."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.tables import load as t  # noqa: F401


def r(c: Column | str, n: int = 6) -> Column:
    """Rounded to what two engines agree on, whatever the order of their sums."""
    return F.round(F.col(c) if isinstance(c, str) else c, n).cast("double")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """All doubles rounded."""
    return df.select(*[r(c, n).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of each event type and day: ``day, event_type, v``."""
    return t(spark, d, "events").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.avg("value").alias("v"))


DAILY = "daily AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)"


def hourly_pair(spark: SparkSession, d: str, a: str, b: str) -> DataFrame:
    """Hourly means of two event types where both have a value: ``ts, a, b``."""
    h = t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type").agg(F.avg("value").alias("v"))
    one = lambda k, n: h.filter(F.col("event_type") == k).select("ts", F.col("v").alias(n))
    return one(a, "a").join(one(b, "b"), "ts")


def pair_sql(a: str, b: str) -> str:
    return f"""pair AS (
  SELECT x.ts, x.v AS a, y.v AS b FROM
    (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS v FROM events WHERE event_type = '{a}' GROUP BY 1) x JOIN
    (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS v FROM events WHERE event_type = '{b}' GROUP BY 1) y USING (ts))"""
