"""p1: continuous periods and gaps of each archive, apart for the two tables that carry year ranges."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators.intervals import merge_intervals, spans_and_gaps
from weftline.tables import load

P1_SQL = """
WITH src AS (
  SELECT 'papyri_documents' AS table_name, archive_key, date_range.year_from AS a, date_range.year_to AS b FROM papyri_documents
  UNION ALL
  SELECT 'canonical_persons', archive_key, year_range.year_from, year_range.year_to FROM canonical_persons),
iv AS (
  SELECT table_name, archive_key, least(coalesce(a, b), coalesce(b, a)) AS lo, greatest(coalesce(a, b), coalesce(b, a)) AS hi
  FROM src WHERE archive_key IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)),
marked AS (
  SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY table_name, archive_key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
    THEN 1 ELSE 0 END AS fresh FROM iv),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY table_name, archive_key ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT table_name, archive_key, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY table_name, archive_key, island),
gaps AS (
  SELECT table_name, archive_key, hi + 1 AS lo, lead(lo) OVER (PARTITION BY table_name, archive_key ORDER BY lo) - 1 AS hi FROM periods)
SELECT table_name, archive_key, 'period' AS span_kind, lo::INTEGER AS year_from, hi::INTEGER AS year_to FROM periods
UNION ALL
SELECT table_name, archive_key, 'gap', lo::INTEGER, hi::INTEGER FROM gaps WHERE hi IS NOT NULL
"""


@query("p1_found", sql=P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [("papyri_documents", "date_range"), ("canonical_persons", "year_range")]
    src = None
    for name, col in sides:
        part = load(spark, sf_dir, name).select(
            F.lit(name).alias("table_name"), "archive_key", F.col(f"{col}.year_from").alias("a"), F.col(f"{col}.year_to").alias("b")
        )
        src = part if src is None else src.unionByName(part)
    rows = spans_and_gaps(merge_intervals(src, ["table_name", "archive_key"], "a", "b"))
    return rows.select("table_name", "archive_key", "span_kind", F.col("lo").cast("int").alias("year_from"), F.col("hi").cast("int").alias("year_to"))
