"""Ordered events within a game: running states, first crossings, milestones, cycles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import sequences as Q
from weftline.operators.series import correlation
from weftline.plans._util import r, rounded, t
from weftline.streaming.machines import active_spans


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as a game: clicks and views score a point each; both running totals stand in every row."""
    e = t(spark, d, "events").select(F.col("user_id").alias("g"), "ts", "event_id", "event_type", "value")
    e = e.withColumn("hp", (F.col("event_type") == "click").cast("int")).withColumn("ap", (F.col("event_type") == "view").cast("int"))
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("hs", F.sum("hp").over(w)).withColumn("aws", F.sum("ap").over(w))


_SCORES = """s AS (SELECT user_id AS g, ts, event_id, event_type, value, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS hp, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS ap,
  sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS hs, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w AS aws
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@query("running_max", "WIN01", sql="""
SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS max_value FROM events""")  # fmt: skip
def running_max(spark: SparkSession, d: str) -> DataFrame:
    return Q.running_max(t(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", "max_value")


@query("first_to_ten", "WIN02", "WIN03", "WIN04", sql=f"""
WITH {_SCORES}, k AS (SELECT g, min(CASE WHEN hs >= 10 THEN (ts, event_id) END) AS h, min(CASE WHEN aws >= 10 THEN (ts, event_id) END) AS a FROM s GROUP BY 1)
SELECT g, CASE WHEN a IS NOT NULL AND (h IS NULL OR a <= h) THEN 'away' ELSE 'home' END AS winner FROM k WHERE h IS NOT NULL OR a IS NOT NULL""")  # fmt: skip
def first_to_ten(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_crossing(_scores(spark, d), ["g"], ["ts", "event_id"], {"home": "hs", "away": "aws"}, 10, first="away")


@query("first_to_ten_unambiguous", "WIN05", sql=f"""
WITH {_SCORES}, k AS (SELECT g, min(CASE WHEN hs >= 10 THEN ts END) AS h, min(CASE WHEN aws >= 10 THEN ts END) AS a FROM s GROUP BY 1)
SELECT g, CASE WHEN h = a THEN NULL WHEN a IS NOT NULL AND (h IS NULL OR a < h) THEN 'away' ELSE 'home' END AS winner FROM k WHERE h IS NOT NULL OR a IS NOT NULL""")  # fmt: skip
def first_to_ten_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_crossing(_scores(spark, d), ["g"], ["ts"], {"home": "hs", "away": "aws"}, 10, tie="null")


@query("crossing_by_step", "WIN03", sql=f"""
WITH {_SCORES} SELECT g, min(event_id) AS n FROM (SELECT g, event_id, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS k FROM s WHERE hs >= 10 AND hs - hp < 10) WHERE k = 1 GROUP BY 1""")  # fmt: skip
def crossing_by_step(spark: SparkSession, d: str) -> DataFrame:
    return Q.crossing_by_step(_scores(spark, d), ["g"], ["ts", "event_id"], "hs", "hp", 10).select("g", F.col("event_id").alias("n"))


@query("plays_to_milestones", "WIN06", sql=f"""
WITH {_SCORES}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY ts, event_id) AS k FROM s)
SELECT g, min(CASE WHEN greatest(hs, aws) >= 5 THEN k END)::INTEGER AS n_to_5, min(CASE WHEN greatest(hs, aws) >= 10 THEN k END)::INTEGER AS n_to_10, count(*) AS n_rows FROM n GROUP BY 1""")  # fmt: skip
def plays_to_milestones(spark: SparkSession, d: str) -> DataFrame:
    return Q.milestones(_scores(spark, d), ["g"], ["ts", "event_id"], F.greatest("hs", "aws"), [5, 10])


@query("final_state", "WIN07", sql=f"""
WITH {_SCORES} SELECT g, arg_max(hs, (ts, event_id))::BIGINT AS hs, arg_max(aws, (ts, event_id))::BIGINT AS aws FROM s GROUP BY 1""")  # fmt: skip
def final_state(spark: SparkSession, d: str) -> DataFrame:
    return Q.last_state(_scores(spark, d), ["g"], ["ts", "event_id"], ["hs", "aws"])


@query("adjacent_dedup", "WIN22", sql="""
WITH k AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, event_type FROM k WHERE n = 1 OR p IS DISTINCT FROM event_type""")  # fmt: skip
def adjacent_dedup(spark: SparkSession, d: str) -> DataFrame:
    return Q.drop_adjacent_repeats(t(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query("active_spans", "STM01", sql="""
WITH k AS (SELECT user_id, ts, event_id, CASE WHEN value >= 40 THEN 1 ELSE 0 END AS o FROM events),
l AS (SELECT *, CASE WHEN lag(o) OVER (PARTITION BY user_id ORDER BY ts) = o THEN 0 ELSE 1 END AS f FROM k),
m AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n_readings FROM m WHERE o = 1 GROUP BY user_id, n""")  # fmt: skip
def active_spans_query(spark: SparkSession, d: str) -> DataFrame:
    return active_spans(t(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", 40)


@query("game_scoring", "AGG05", "ARR01", "ARR11", sql="""
WITH w AS (SELECT fetch_no, payload FROM season_pbp_2026 WHERE payload IS NOT NULL AND payload <> '' AND json_valid(payload)),
p AS (SELECT fetch_no, e.value AS j FROM w, json_each(payload, '$.plays') e WHERE json_type(e.value) = 'OBJECT')
SELECT fetch_no, count(*) AS n_plays, count_if(json_type(j, '$.scoringPlay') = 'BOOLEAN' AND (j->>'$.scoringPlay') = 'true')::BIGINT AS n_scoring,
  count_if(length(j->>'$.text') > 5)::BIGINT AS n_texts FROM p GROUP BY 1""")  # fmt: skip
def game_scoring(spark: SparkSession, d: str) -> DataFrame:
    from weftline.plans.p02_nested import p2_plays

    p = p2_plays(spark, d)
    return p.groupBy("fetch_no").agg(F.count("*").alias("n_plays"), F.count_if(F.col("scoring_play")).alias("n_scoring"), F.count_if(F.length("text") > 5).alias("n_texts"))


@query("game_first_to_ten", "WIN02", "STM03", sql="""
WITH w AS (SELECT fetch_no, payload FROM season_pbp_2026 WHERE payload IS NOT NULL AND payload <> '' AND json_valid(payload)),
p AS (SELECT fetch_no, e.key::BIGINT AS k, try_cast(e.value->>'$.homeScore' AS INTEGER) AS h, try_cast(e.value->>'$.awayScore' AS INTEGER) AS a FROM w, json_each(payload, '$.plays') e WHERE json_type(payload, '$.plays') = 'ARRAY' AND json_type(e.value) = 'OBJECT'),
g AS (SELECT fetch_no, min(CASE WHEN h >= 10 THEN k END) AS h, min(CASE WHEN a >= 10 THEN k END) AS a FROM p GROUP BY 1)
SELECT fetch_no, CASE WHEN h IS NULL OR a <= h THEN 'away' ELSE 'home' END AS winner FROM g WHERE a IS NOT NULL OR h IS NOT NULL""")  # fmt: skip
def game_first_to_ten(spark: SparkSession, d: str) -> DataFrame:
    """The side that first has ten points in each fetch of a real game, away first if both do in one play."""
    from weftline.plans.p02_nested import p2_plays

    return Q.first_crossing(p2_plays(spark, d), ["fetch_no"], ["play_no"], {"home": "home_score", "away": "away_score"}, 10, first="away")


@query("tempo_outlook", "AGG06", "INF14", sql="""
WITH k AS (SELECT user_id, list(value ORDER BY value) AS l FROM events GROUP BY 1) SELECT user_id, round(l[len(l) // 2 + 1], 6) AS upper_median FROM k""")  # fmt: skip
def tempo_outlook(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.stats import upper_median

    return rounded(upper_median(t(spark, d, "events"), ["user_id"], "value"))


@query("correlation_row", "INF12", sql="""
WITH k AS (SELECT user_id, avg(value) AS x, stddev_pop(value) AS y, count(*)::DOUBLE AS z FROM events GROUP BY 1),
c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM k)
SELECT round(xy, 5) AS xy, round(xz, 5) AS xz, round(yz, 5) AS yz, round((xy - xz * yz) / sqrt(1 - xz * xz), 5) AS semi_partial FROM c""")  # fmt: skip
def correlation_row(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.stats import semi_partial

    k = t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("x"), F.stddev_pop("value").alias("y"), F.count("*").cast("double").alias("z"))
    c = k.agg(*[correlation(F.col(a), F.col(b)).alias(a + b) for a, b in ("xy", "xz", "yz")])
    return c.select(r("xy", 5).alias("xy"), r("xz", 5).alias("xz"), r("yz", 5).alias("yz"), r(semi_partial(F.col("xy"), F.col("xz"), F.col("yz")), 5).alias("semi_partial"))
