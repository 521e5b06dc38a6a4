"""Capture audits: gaps, manifests, late data, firewalls, leakage, planning."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import quality as D
from weftline.plans._util import r, t


@query("gap_report", "JON22", "DQ05", sql="""
WITH e AS (SELECT h, k FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS h FROM events), (SELECT DISTINCT event_type AS k FROM events))
SELECT h::TIMESTAMP AS hour, k AS event_type FROM e WHERE NOT EXISTS (SELECT 1 FROM events WHERE date_trunc('hour', ts) = h AND event_type = k)""")  # fmt: skip
def gap_report(spark: SparkSession, d: str) -> DataFrame:
    ev = t(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    grid = D.expected_grid(ev, "hour", "hour", ev.select("event_type"))
    return D.gaps(grid.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type"), ev, ["hour", "event_type"])


@query("manifest_rollup", "AGG37", sql="""
WITH k AS (SELECT batch_date, captured_at::DATE <= batch_date AND xml IS NOT NULL AS ok FROM papyri_documents)
SELECT batch_date, count(*) AS n_expected, count_if(ok)::BIGINT AS n_ok, count_if(NOT ok)::BIGINT AS n_failed, bool_and(ok) AS complete FROM k GROUP BY 1""")  # fmt: skip
def manifest_rollup(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.to_date("captured_at") <= F.col("batch_date")) & F.col("xml").isNotNull()
    return D.rollup(t(spark, d, "papyri_documents"), ["batch_date"], ok)


@query("late_flags", "STM05", sql="""
SELECT row_no, coalesce(captured_at::DATE <> batch_date, false) AS is_late FROM papyri_documents""")  # fmt: skip
def late_flags(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "papyri_documents").select("row_no", D.late(F.col("batch_date"), F.col("captured_at")).alias("is_late"))


@query("firewall", "DQ01", sql="""
WITH f AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN 'verification' ELSE 'feature' END || '/' || source || '/' || coalesce(lang, 'none') AS path FROM documents),
s AS (SELECT path, split_part(path, '/', 1) AS tree, split_part(path, '/', 2) AS src FROM f),
g AS (SELECT source AS src, CASE WHEN max_repeats > 1 THEN 'feature' ELSE 'verification' END AS role FROM mix_targets)
SELECT path, CASE WHEN role IS NULL THEN 'unknown source' ELSE 'wrong tree' END AS problem FROM s LEFT JOIN g USING (src) WHERE role IS NULL OR role <> tree""")  # fmt: skip
def firewall(spark: SparkSession, d: str) -> DataFrame:
    tree = F.when(F.col("doc_id") % 7 == 0, "verification").otherwise("feature")
    files = t(spark, d, "documents").select(F.concat_ws("/", tree, "source", F.coalesce("lang", F.lit("none"))).alias("path")).distinct()
    roles = t(spark, d, "mix_targets").select("source", F.when(F.col("max_repeats") > 1, "feature").otherwise("verification").alias("role"))
    return D.firewall(files, "path", roles, "source", "role")


@query("provenance_mix", "DQ02", sql="""
SELECT home_team, count(DISTINCT stats_source) AS n_provenances FROM predictions_2026 GROUP BY 1 HAVING count(DISTINCT stats_source) > 1""")  # fmt: skip
def provenance_mix(spark: SparkSession, d: str) -> DataFrame:
    return D.mixed_provenance(t(spark, d, "predictions_2026"), ["home_team"], "stats_source")


@query("leakage", "DQ03", sql="""
SELECT prediction_id, coalesce(predicted_at > game_date + INTERVAL 19 HOUR, true) AS leaks, round((epoch(game_date + INTERVAL 19 HOUR) - epoch(predicted_at)) / 3600, 4) AS lead_hours FROM predictions_2026""")  # fmt: skip
def leakage(spark: SparkSession, d: str) -> DataFrame:
    gate = F.col("game_date").cast("timestamp_ntz") + F.expr("interval 19 hours")
    lead = (F.unix_timestamp(gate.cast("timestamp")) - F.unix_timestamp(F.col("predicted_at").cast("timestamp"))) / 3600
    return t(spark, d, "predictions_2026").select("prediction_id", D.leaking(F.col("predicted_at"), gate).alias("leaks"), r(lead, 4).alias("lead_hours"))


@query("resumable_plan", "DQ07", "JON15", sql="""
WITH c AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS month),
u AS (SELECT date_trunc('month', o_orderdate)::DATE AS month FROM orders GROUP BY 1 HAVING count(*) >= 150),
m AS (SELECT month, 10.0 AS cost FROM c WHERE month NOT IN (SELECT month FROM u)), s AS (SELECT month, sum(cost) OVER (ORDER BY month)::DOUBLE AS spent FROM m)
SELECT month, spent FROM s WHERE spent <= 120""")  # fmt: skip
def resumable_plan(spark: SparkSession, d: str) -> DataFrame:
    chunks = spark.range(1).select(F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("interval 1 month"))).alias("month"), F.lit(10.0).alias("cost"))
    usable = t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n")).filter("n >= 150")
    return D.plan(chunks, usable, ["month"], ["month"], "cost", 120.0).select("month", "spent")


@query("captured_json", "ARR07", sql="""
SELECT game_id, count(*) AS n_fetches, count_if(payload IS NOT NULL AND payload <> '' AND json_valid(payload))::BIGINT AS n_usable FROM season_pbp_2026 GROUP BY 1""")  # fmt: skip
def captured_json(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.try_parse_json("payload").isNotNull() & (F.col("payload") != ""), F.lit(False))
    return t(spark, d, "season_pbp_2026").groupBy("game_id").agg(F.count("*").alias("n_fetches"), F.count_if(ok).alias("n_usable"))
