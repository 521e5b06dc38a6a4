"""Projections, filters, joins, aggregations, set operations and sorts."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import scores
from weftline.operators import relational as R
from weftline.plans._util import r, rounded, t

# -- team-like statistics: suppliers as teams, orders as games ------------------------------------------------------------


@query("matchup_features", "PRJ08", "PRJ10", "JON03", "JON04", "ARR04", sql="""
SELECT p.prediction_id, coalesce(h.avg_pts, 70.0) AS home_pts, coalesce(a.avg_pts, 70.0) AS away_pts, round(coalesce(h.avg_pts, 70.0) - coalesce(a.avg_pts, 70.0), 6) AS diff,
  round(coalesce(h.avg_pts, 70.0) + coalesce(a.avg_pts, 70.0), 6) AS total,
  CASE WHEN coalesce(a.avg_pts, 70.0) = 0 THEN 0.5 ELSE round(coalesce(h.avg_pts, 70.0) / (coalesce(h.avg_pts, 70.0) + coalesce(a.avg_pts, 70.0)), 6) END AS share,
  CASE WHEN h.team_id IS NULL THEN 'default' ELSE 'found' END AS home_source
FROM predictions_2026 p LEFT JOIN (SELECT team_name, min(team_id) AS team_id, arg_min(avg_pts, team_id) AS avg_pts FROM team_stats_2026 GROUP BY 1) h ON h.team_name = p.home_team
LEFT JOIN (SELECT team_name, arg_min(avg_pts, team_id) AS avg_pts FROM team_stats_2026 GROUP BY 1) a ON a.team_name = p.away_team""")  # fmt: skip
def matchup_features(spark: SparkSession, d: str) -> DataFrame:
    dim = R.keep_first(t(spark, d, "team_stats_2026").select("team_name", "team_id", "avg_pts"), ["team_name"], ["team_id"])
    p = t(spark, d, "predictions_2026").select("prediction_id", "home_team", "away_team")
    p = R.lookup(p, dim, {"home_team": "team_name"}, {"avg_pts": 70.0}, "home_source").withColumnRenamed("avg_pts", "home_pts")
    p = R.lookup(p, dim, {"away_team": "team_name"}, {"avg_pts": 70.0}).withColumnRenamed("avg_pts", "away_pts")
    h, a = F.col("home_pts"), F.col("away_pts")
    return rounded(p.select("prediction_id", "home_pts", "away_pts", (h - a).alias("diff"), (h + a).alias("total"), F.when(a == 0, 0.5).otherwise(h / (h + a)).alias("share"), "home_source"))


@query("mirror_augment", "PRJ03", sql="""
WITH b AS (SELECT prediction_id, home_opp_ppg AS h, away_opp_ppg AS a, round(home_opp_ppg - away_opp_ppg, 6) AS diff, prob_home_f10 AS p FROM predictions_2026)
SELECT prediction_id, h, a, diff, p, false AS mirrored FROM b UNION ALL SELECT prediction_id, a, h, -diff, 1 - p, true FROM b""")  # fmt: skip
def mirror_augment(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "predictions_2026").select("prediction_id", F.col("home_opp_ppg").alias("h"), F.col("away_opp_ppg").alias("a"), r(F.col("home_opp_ppg") - F.col("away_opp_ppg")).alias("diff"), F.col("prob_home_f10").alias("p"))
    return R.mirrored(b, [("h", "a")], ["diff"], ["p"])


@query("team_stats_min_games", "AGG03", "AGG04", "AGG05", "FIL05", "SRT04", sql="""
WITH u AS (SELECT l_suppkey AS k, l_quantity AS q, 1 AS home FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_suppkey, l_quantity, 0 FROM lineitem WHERE l_linenumber % 2 = 0),
g AS (SELECT k, count(*) AS n, avg(q) AS pace, sum(q * home) AS home_sum, count_if(home = 1)::BIGINT AS n_home FROM u GROUP BY 1 HAVING count(*) >= 5)
SELECT k, n, round(pace, 6) AS pace, round(home_sum, 4) AS home_sum, n_home, round(pace / (SELECT avg(pace) FROM g), 6) AS pace_ratio FROM g""")  # fmt: skip
def team_stats_min_games(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("q"), (F.col("l_linenumber") % 2).alias("home"))
    g = li.groupBy("k").agg(F.count("*").alias("n"), F.avg("q").alias("pace"), F.sum(F.col("q") * F.col("home")).alias("home_sum"), F.count_if(F.col("home") == 1).alias("n_home")).filter("n >= 5")
    mean = g.agg(F.avg("pace").alias("m"))
    return g.join(F.broadcast(mean)).select("k", "n", r("pace").alias("pace"), r("home_sum", 4).alias("home_sum"), "n_home", r(F.col("pace") / F.col("m")).alias("pace_ratio"))


@query("tempo_stats", "AGG06", sql="""
SELECT l_suppkey AS k, round(median(l_quantity), 6) AS median_q, round(stddev_pop(l_quantity), 6) AS sd_q, round(avg(l_quantity), 6) AS mean_q,
  round(median(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 6) AS median_r, round(median(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), 6) AS median_other,
  round((coalesce(median(CASE WHEN l_returnflag = 'R' THEN l_quantity END), median(l_quantity)) + coalesce(median(CASE WHEN l_returnflag <> 'R' THEN l_quantity END), median(l_quantity))) / 2, 6) AS blended
FROM lineitem GROUP BY 1""")  # fmt: skip
def tempo_stats(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    ret, oth = F.median(F.when(F.col("l_returnflag") == "R", q)), F.median(F.when(F.col("l_returnflag") != "R", q))
    return rounded(
        t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
            F.median(q).alias("median_q"), F.stddev_pop(q).alias("sd_q"), F.avg(q).alias("mean_q"), ret.alias("median_r"), oth.alias("median_other"),
            ((F.coalesce(ret, F.median(q)) + F.coalesce(oth, F.median(q))) / 2).alias("blended"))
    )


@query("named_multi_agg", "AGG01", "AGG02", "AGG39", sql="""
SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS hi, min(CASE WHEN o_totalprice > 100000 THEN o_totalprice END) AS lo_large, arg_min(o_orderpriority, o_orderkey) AS first_priority
FROM orders GROUP BY 1""")  # fmt: skip
def named_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.max(p).alias("hi"), F.min(F.when(p > 100000, p)).alias("lo_large"), F.min_by("o_orderpriority", "o_orderkey").alias("first_priority")
    )


@query("masks_and_ranges", "FIL01", "FIL02", "FIL03", "FIL04", "FIL14", "FIL16", sql="""
SELECT prediction_id, home_team, away_team FROM predictions_2026
WHERE status IN ('STATUS_FINAL', 'STATUS_SCHEDULED') AND status NOT IN ('STATUS_POSTPONED') AND home_ppg IS NOT NULL AND NOT isnan(home_ppg) AND home_ppg >= 0
  AND total_ppg BETWEEN 80 AND 220 AND edge_pct >= 5 AND trim(home_team) <> '' AND upper(home_team) <> 'TBD'""")  # fmt: skip
def masks_and_ranges(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return (
        t(spark, d, "predictions_2026")
        .filter(c("status").isin("STATUS_FINAL", "STATUS_SCHEDULED") & ~c("status").isin("STATUS_POSTPONED") & c("home_ppg").isNotNull() & ~F.isnan("home_ppg") & (c("home_ppg") >= 0))
        .filter(c("total_ppg").between(80, 220) & (c("edge_pct") >= 5) & (F.trim("home_team") != "") & (F.upper("home_team") != "TBD"))
        .select("prediction_id", "home_team", "away_team")
    )


@query("contains_filter", "FIL07", "FIL08", "FIL15", sql="""
SELECT p_partkey, p_name, regexp_matches(p_partkey::VARCHAR, '^1[0-9]{2}$') AS three_digits FROM part WHERE lower(p_name) LIKE '%ring%' AND p_type ILIKE '%a%' AND NOT regexp_matches(p_brand, '^[0-9]+$')""")  # fmt: skip
def contains_filter(spark: SparkSession, d: str) -> DataFrame:
    return (
        t(spark, d, "part").filter(F.lower("p_name").contains("ring") & F.col("p_type").ilike("%a%") & ~F.col("p_brand").rlike(r"^[0-9]+$"))
        .select("p_partkey", "p_name", F.col("p_partkey").cast("string").rlike(r"^1\d{2}$").alias("three_digits"))
    )


@query("archive_rule", "FIL09", "FIL10", "FIL12", "SRT06", sql="""
SELECT row_no FROM papyri_documents
WHERE archive_key = 'arch00000001' OR (coalesce(date_range.year_from, date_range.year_to) <= 250 AND coalesce(date_range.year_to, date_range.year_from) >= 100 AND text LIKE '%καὶ%')
ORDER BY row_no LIMIT 200""")  # fmt: skip
def archive_rule(spark: SparkSession, d: str) -> DataFrame:
    lo, hi = F.coalesce("date_range.year_from", "date_range.year_to"), F.coalesce("date_range.year_to", "date_range.year_from")
    rule = (F.col("archive_key") == "arch00000001") | ((lo <= 250) & (hi >= 100) & F.col("text").contains("καὶ"))
    return t(spark, d, "papyri_documents").filter(rule).select("row_no").orderBy("row_no").limit(200)


# -- joins -----------------------------------------------------------------------------------------------------------------


@query("outer_align", "JON01", "JON02", sql="""
WITH a AS (SELECT o_custkey AS k, count(*) AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n_final FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT k, n_open, n_final, CASE WHEN n_open IS NULL THEN 'final' WHEN n_final IS NULL THEN 'open' WHEN n_open <= n_final THEN 'open first' ELSE 'final first' END AS side
FROM a FULL JOIN b USING (k)""")  # fmt: skip
def outer_align(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    side = lambda s, n: o.filter(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    j = side("O", "n_open").join(side("F", "n_final"), "k", "full_outer")
    label = F.when(F.col("n_open").isNull(), "final").when(F.col("n_final").isNull(), "open").when(F.col("n_open") <= F.col("n_final"), "open first").otherwise("final first")
    return j.withColumn("side", label)


_BRIDGE = """WITH a AS (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), b AS (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P'),
c AS (SELECT c_custkey AS o_custkey, lower(trim(c_mktsegment)) AS segment FROM customer WHERE c_acctbal > 0)"""


def _bridge(spark: SparkSession, d: str):
    a = t(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q")).withColumn("key", F.concat_ws("-", "l_orderkey", "l_partkey"))
    b = t(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lower(F.trim("c_mktsegment")).alias("segment"))
    return R.bridge(a, b, c, ["l_orderkey"], ["o_custkey"], "key")


@query("bridge_join", "JON05", sql=_BRIDGE + " SELECT segment, count(*) AS n, round(sum(q), 4) AS q FROM a JOIN b USING (l_orderkey) JOIN c USING (o_custkey) GROUP BY 1")
def bridge_join(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d)[0].groupBy("segment").agg(F.count("*").alias("n"), r(F.sum("q"), 4).alias("q"))


@query("bridge_unmatched", "DQ08", "JON05", sql=_BRIDGE + """
SELECT l_orderkey || '-' || l_partkey AS key, 'no bridge' AS reason FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = a.l_orderkey)
UNION ALL SELECT a.l_orderkey || '-' || l_partkey, 'no target' FROM a JOIN b USING (l_orderkey) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = b.o_custkey)""")  # fmt: skip
def bridge_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _bridge(spark, d)[1]


@query("enrich_fill", "JON13", sql="""
WITH h AS (SELECT hgv_id, arg_max(place, row_no) AS p FROM papyri_documents WHERE hgv_id IS NOT NULL AND place IS NOT NULL AND trim(place) <> '' GROUP BY 1)
SELECT row_no, coalesce(nullif(trim(place), ''), p) AS filled, coalesce(p, nullif(trim(place), '')) AS overridden FROM papyri_documents d LEFT JOIN h USING (hgv_id)""")  # fmt: skip
def enrich_fill(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "papyri_documents").select("row_no", "hgv_id", "place")
    full = docs.filter("hgv_id is not null and place is not null and trim(place) <> ''")
    index = R.keep_last(full, ["hgv_id"], ["row_no"]).select("hgv_id", F.col("place").alias("filled"), F.col("place").alias("overridden"))
    base = docs.select("row_no", "hgv_id", F.nullif(F.trim("place"), F.lit("")).alias("filled"), F.nullif(F.trim("place"), F.lit("")).alias("overridden"))
    return R.fill_from(base, index, "hgv_id", ["filled"], ["overridden"]).select("row_no", "filled", "overridden")


@query("semi_join", "JON14", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    rich = t(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("anti_join", "JON15", "SET03", sql="SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    rich = t(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, d, "customer").select("c_custkey").join(rich, "c_custkey", "left_anti")


@query("nested_export", "JON16", sql="""
WITH k AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey AS id, coalesce(n, 0)::BIGINT AS n_children, coalesce(array_to_string(l, ','), '') AS children FROM customer LEFT JOIN k ON o_custkey = c_custkey""")  # fmt: skip
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    n = R.nest(c, o, "id", ["o_orderkey"], "kids", ["o_orderkey"])
    return n.select("id", F.size("kids").cast("bigint").alias("n_children"), F.array_join(F.transform("kids", lambda k: k["o_orderkey"].cast("string")), ",").alias("children"))


@query("substring_match", "JON17", "ENT04", sql="""
WITH l AS (SELECT DISTINCT listed_name AS rt, ' ' || trim(regexp_replace(lower(listed_name), '[^a-z0-9_]+', ' ', 'g')) || ' ' AS rp FROM book_teams),
s AS (SELECT DISTINCT team_name AS lt, ' ' || trim(regexp_replace(lower(team_name), '[^a-z0-9_]+', ' ', 'g')) || ' ' AS lp FROM team_stats_2026)
SELECT lt, rt FROM s, l WHERE contains(lp, rp) OR contains(rp, lp)""")  # fmt: skip
def substring_match(spark: SparkSession, d: str) -> DataFrame:
    return R.contains_match(t(spark, d, "team_stats_2026"), t(spark, d, "book_teams"), "team_name", "listed_name")


@query("cascade_match", "JON18", "STR19", sql="""
WITH b AS (SELECT book_team_id, lower(listed_name) AS k, lower(split_part(trim(listed_name), ' ', 1)) AS w FROM book_teams),
e AS (SELECT lower(team_name) AS k, min(team_id) AS v FROM team_stats_2026 GROUP BY 1), f AS (SELECT lower(split_part(trim(team_name), ' ', 1)) AS w, min(team_id) AS v FROM team_stats_2026 GROUP BY 1)
SELECT book_team_id, coalesce(e.v, f.v) AS v, CASE WHEN e.v IS NOT NULL THEN 'exact' WHEN f.v IS NOT NULL THEN 'first word' END AS matched_by FROM b LEFT JOIN e USING (k) LEFT JOIN f USING (w)""")  # fmt: skip
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    word = lambda c: F.lower(F.split_part(F.trim(c), F.lit(" "), F.lit(1)))
    s = t(spark, d, "team_stats_2026")
    b = t(spark, d, "book_teams").select("book_team_id", F.lower("listed_name").alias("k"), word("listed_name").alias("w"))
    exact = s.groupBy(F.lower("team_name").alias("k")).agg(F.min("team_id").alias("v"))
    first = s.groupBy(word("team_name").alias("w")).agg(F.min("team_id").alias("v"))
    by_word = b.select("k", "w").distinct().join(first, "w").groupBy("k").agg(F.min("v").alias("v"))
    return R.cascade(b, "k", [("exact", exact), ("first word", by_word)], "v").select("book_team_id", "v", "matched_by")


@query("weighted_composite", "JON23", "AGG21", sql="""
WITH w(p_brand, w) AS (VALUES ('Brand#11', 0.5), ('Brand#12', 0.3), ('Brand#13', 0.2)), s AS (SELECT p_size, p_brand, avg(p_retailprice) AS x FROM part GROUP BY ALL)
SELECT p_size, round(sum(x * w::DOUBLE) / sum(w::DOUBLE), 4) AS score, count(*) AS n_parts FROM s JOIN w USING (p_brand) GROUP BY 1""")  # fmt: skip
def weighted_composite(spark: SparkSession, d: str) -> DataFrame:
    w = spark.createDataFrame([("Brand#11", 0.5), ("Brand#12", 0.3), ("Brand#13", 0.2)], "p_brand string, w double")
    s = t(spark, d, "part").groupBy("p_size", "p_brand").agg(F.avg("p_retailprice").alias("x"))
    return s.join(F.broadcast(w), "p_brand").groupBy("p_size").agg(r(F.sum(F.col("x") * F.col("w")) / F.sum("w"), 4).alias("score"), F.count("*").alias("n_parts"))


@query("update_single", "SNK10", sql="""
WITH u AS (SELECT listed_name AS team_name, count(*) AS n, min(points_pg) AS p FROM book_teams GROUP BY 1)
SELECT team_id, coalesce(CASE WHEN n = 1 THEN p END, avg_pts) AS avg_pts FROM team_stats_2026 s LEFT JOIN u USING (team_name)""")  # fmt: skip
def update_single(spark: SparkSession, d: str) -> DataFrame:
    s = t(spark, d, "team_stats_2026").select("team_id", "team_name", "avg_pts")
    u = t(spark, d, "book_teams").select("listed_name", F.col("points_pg").alias("p"))
    return R.update_if_single(s, "team_name", u.withColumnRenamed("p", "avg_pts"), "listed_name", "avg_pts").select("team_id", "avg_pts")


# -- aggregations ------------------------------------------------------------------------------------------------------------


@query("pivot_sums", "AGG18", "EXT09", sql="""
SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 4) AS q_f, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 4) AS q_o FROM lineitem GROUP BY 1""")  # fmt: skip
def pivot_sums(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", r("F", 4).alias("q_f"), r("O", 4).alias("q_o"))


@query("calibration", "AGG31", "ML06", "MTH16", sql="""
WITH b AS (SELECT prob_home_f10 AS p, CASE WHEN edge_team = home_team THEN 1 ELSE 0 END AS y FROM predictions_2026 WHERE prob_home_f10 IS NOT NULL)
SELECT floor(p * 10 + 0.5) / 10 AS bucket, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate, round(avg((p - y) * (p - y)), 6) AS brier,
  round(abs(avg(p) - avg(y)), 6) AS calibration_error, CASE WHEN abs(avg(p) - avg(y)) < 0.1 THEN 'good' ELSE 'off' END AS verdict FROM b GROUP BY 1""")  # fmt: skip
def calibration(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null").select(F.col("prob_home_f10").alias("p"), F.when(F.col("edge_team") == F.col("home_team"), 1).otherwise(0).alias("y"))
    err = F.abs(F.avg("p") - F.avg("y"))
    return rounded(
        b.groupBy((F.floor(F.col("p") * 10 + 0.5) / 10).alias("bucket")).agg(
            F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
            err.alias("calibration_error"), F.when(err < 0.1, "good").otherwise("off").alias("verdict"))
    )


@query("brier_logloss", "AGG31", "AGG32", sql="""
WITH b AS (SELECT least(1 - 1e-12, greatest(1e-12, prob_home_f10)) AS p, CASE WHEN edge_team = home_team THEN 1 ELSE 0 END AS y, edge_pct FROM predictions_2026 WHERE prob_home_f10 IS NOT NULL)
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round(quantile_cont(edge_pct, 0.05), 6) AS p05, round(median(edge_pct), 6) AS p50, round(avg(CASE WHEN edge_pct < 1 THEN 1.0 ELSE 0.0 END), 6) AS ruin FROM b""")  # fmt: skip
def brier_logloss(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null").select("edge_pct", F.col("prob_home_f10").alias("p"), F.when(F.col("edge_team") == F.col("home_team"), 1).otherwise(0).alias("y"))
    p, y = F.col("p"), F.col("y")
    return rounded(b.agg(
        F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(scores.log_loss(p, y)).alias("log_loss"), F.avg(F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)).alias("accuracy"),
        F.percentile("edge_pct", F.lit(0.05)).alias("p05"), F.median("edge_pct").alias("p50"), F.avg(F.when(F.col("edge_pct") < 1, 1.0).otherwise(0.0)).alias("ruin")))


@query("auc_rank", "ML03", sql="""
WITH b AS (SELECT edge_pct AS s, CASE WHEN edge_team = home_team THEN 1 ELSE 0 END AS y FROM predictions_2026 WHERE edge_pct IS NOT NULL),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM b)
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0) / (count_if(y = 1) * count_if(y = 0)), 6)::DOUBLE AS auc FROM k""")  # fmt: skip
def auc_rank(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators.stats import rank_auc

    b = t(spark, d, "predictions_2026").filter("edge_pct is not null").select(F.col("edge_pct").alias("s"), F.when(F.col("edge_team") == F.col("home_team"), 1).otherwise(0).alias("y"))
    return rounded(rank_auc(b, "s", "y"))


@query("round_reach", "AGG36", sql="""
WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT n, count(*) AS customers FROM c GROUP BY 1)
SELECT n, customers, round(customers / (SELECT sum(customers) FROM k)::DOUBLE, 6) AS share, n = (SELECT arg_min(n, (-customers, n)) FROM k) AS modal FROM k""")  # fmt: skip
def round_reach(spark: SparkSession, d: str) -> DataFrame:
    k = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("customers"))
    tot = k.agg(F.sum("customers").alias("s"), F.min_by("n", F.struct(-F.col("customers"), F.col("n"))).alias("m"))
    return k.join(F.broadcast(tot)).select("n", "customers", r(F.col("customers") / F.col("s")).alias("share"), (F.col("n") == F.col("m")).alias("modal"))


@query("first_nonempty_category", "AGG41", "ARR06", sql="""
SELECT p_brand, CASE WHEN max(p_size) > 48 THEN 'd4' WHEN max(p_size) > 40 THEN 'd3' ELSE 'none' END AS worst, bool_or(p_size > 45) AS any_large, bool_and(p_size > 0) AS all_positive FROM part GROUP BY 1""")  # fmt: skip
def first_nonempty_category(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return t(spark, d, "part").groupBy("p_brand").agg(
        F.coalesce(F.when(F.max(s) > 48, "d4"), F.when(F.max(s) > 40, "d3"), F.lit("none")).alias("worst"), F.bool_or(s > 45).alias("any_large"), F.bool_and(s > 0).alias("all_positive")
    )


# -- sets, dedup, sorts --------------------------------------------------------------------------------------------------------


@query("first_wins_dedup", "SET05", "SET06", sql="""
SELECT record_id, min(row_no) AS row_no, arg_min(title, row_no) AS title FROM papyri_documents WHERE record_id IS NOT NULL GROUP BY 1""")  # fmt: skip
def first_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "papyri_documents").filter("record_id is not null").select("record_id", "row_no", "title")
    return R.keep_first(docs, ["record_id"], ["row_no"])


@query("last_wins_dedup", "SET07", sql="SELECT game_id, max(fetch_no) AS fetch_no, arg_max(length(payload), fetch_no)::INTEGER AS size FROM season_pbp_2026 GROUP BY 1")
def last_wins_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_last(t(spark, d, "season_pbp_2026").select("game_id", "fetch_no", F.length("payload").alias("size")), ["game_id"], ["fetch_no"])


@query("priority_union", "SET01", "SET04", "SET08", sql="""
WITH u AS (SELECT team_name AS k, 0 AS src FROM team_stats_2026 UNION ALL SELECT listed_name, 1 FROM book_teams UNION ALL SELECT home_team, 2 FROM predictions_2026)
SELECT k, min(src)::INTEGER AS src FROM u GROUP BY 1""")  # fmt: skip
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    frames = [t(spark, d, n).select(F.col(c).alias("k"), F.lit(i).alias("src")) for i, (n, c) in enumerate([("team_stats_2026", "team_name"), ("book_teams", "listed_name"), ("predictions_2026", "home_team")])]
    return R.priority_union(frames, "k")


@query("set_algebra", "SET02", "SET03", "SET04", "SET10", sql="""
(SELECT 'both' AS kind, team_name AS k FROM (SELECT team_name FROM team_stats_2026 INTERSECT SELECT home_team FROM predictions_2026)) UNION ALL
(SELECT 'predicted only', home_team FROM (SELECT home_team FROM predictions_2026 EXCEPT SELECT team_name FROM team_stats_2026))""")  # fmt: skip
def set_algebra(spark: SparkSession, d: str) -> DataFrame:
    a, b = t(spark, d, "team_stats_2026").select(F.col("team_name").alias("k")), t(spark, d, "predictions_2026").select(F.col("home_team").alias("k"))
    return a.intersect(b).select(F.lit("both").alias("kind"), "k").unionByName(b.subtract(a).select(F.lit("predicted only").alias("kind"), "k"))


@query("top_orders", "SRT01", "SRT02", "SRT05", "SRT07", "SRT08", sql="""
SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")  # fmt: skip
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("status_order", "SRT03", "WIN27", sql="""
WITH k AS (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)::INTEGER AS rn FROM orders)
SELECT o_orderstatus, o_orderkey, rn, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS prio FROM k WHERE rn <= 10""")  # fmt: skip
def status_order(spark: SparkSession, d: str) -> DataFrame:
    prio = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rn = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))  # Spark keeps ten rows a task before it shuffles
    return t(spark, d, "orders").withColumn("rn", rn).filter("rn <= 10").select("o_orderstatus", "o_orderkey", "rn", prio.alias("prio")).orderBy("prio", "rn")


@query("display_cells", "PRJ06", "PRJ07", sql="""
SELECT team_id, coalesce(printf('%.2f', avg_pts), '') AS avg_pts, coalesce(printf('%+.5f', pace_ratio), '') AS pace_ratio, coalesce(team_name, '') AS team_name FROM team_stats_2026""")  # fmt: skip
def display_cells(spark: SparkSession, d: str) -> DataFrame:
    s = R.reorder(t(spark, d, "team_stats_2026"), ["team_id", "avg_pts", "pace_ratio", "team_name"])
    return s.select("team_id", F.coalesce(F.format_string("%.2f", F.col("avg_pts")), F.lit("")).alias("avg_pts"), F.coalesce(F.format_string("%+.5f", F.col("pace_ratio")), F.lit("")).alias("pace_ratio"), F.coalesce("team_name", F.lit("")).alias("team_name"))


# -- arrays, maps, JSON --------------------------------------------------------------------------------------------------------


@query("cross_ref_keys", "PRJ11", "ARR03", "ARR05", sql="""
SELECT row_no, lower(e.key) AS k, array_to_string(e.value, ';') AS ids FROM (SELECT row_no, unnest(map_entries(cross_refs)) AS e FROM papyri_documents) WHERE lower(e.key) IN ('tm', 'hgv')""")  # fmt: skip
def cross_ref_keys(spark: SparkSession, d: str) -> DataFrame:
    m = F.map_filter(F.transform_keys("cross_refs", lambda k, v: F.lower(k)), lambda k, v: k.isin("tm", "hgv"))
    return t(spark, d, "papyri_documents").select("row_no", F.explode(m).alias("k", "v")).select("row_no", "k", F.array_join("v", ";").alias("ids"))


@query("nested_lookup", "ARR04", "ARR07", "EXT15", sql="""
SELECT fetch_no, payload IS NOT NULL AND payload <> '' AND json_valid(payload) AS whole,
  CASE WHEN payload <> '' AND json_valid(payload) THEN coalesce(payload->>'$.header.id', 'none') ELSE 'none' END AS header_id
FROM season_pbp_2026""")  # fmt: skip
def nested_lookup(spark: SparkSession, d: str) -> DataFrame:
    whole = F.coalesce(F.try_parse_json("payload").isNotNull() & (F.col("payload") != ""), F.lit(False))
    got = F.when(whole, F.coalesce(F.get_json_object("payload", "$.header.id"), F.lit("none"))).otherwise("none")
    return t(spark, d, "season_pbp_2026").select("fetch_no", whole.alias("whole"), got.alias("header_id"))


@query("event_props", "ARR01", "ARR08", "EXT15", sql="""
SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS sum_k FROM events GROUP BY 1""")  # fmt: skip
def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"))


@query("members_unpivot", "ARR08", "EXT09", sql="""
SELECT team_id, member, v FROM (UNPIVOT (SELECT team_id, avg_pts, avg_opp_pts, avg_pace FROM team_stats_2026) ON avg_pts, avg_opp_pts, avg_pace INTO NAME member VALUE v)""")  # fmt: skip
def members_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "team_stats_2026").unpivot("team_id", ["avg_pts", "avg_opp_pts", "avg_pace"], "member", "v").filter("v is not null")


# -- scores and odds --------------------------------------------------------------------------------------------------------------


@query("score_maps", "MTH01", "MTH02", "MTH03", "MTH06", sql="""
SELECT event_id, round(least(100, greatest(0, 100 - 0.6 * value)), 6)::DOUBLE AS line, round(least(100, greatest(0, CASE WHEN value <= 20 THEN 100 - value WHEN value <= 80 THEN 90 - 0.5 * value ELSE 40 - 0.1 * value END)), 6)::DOUBLE AS pieces,
  CASE WHEN value >= 90 THEN 'A' WHEN value >= 75 THEN 'B' WHEN value >= 60 THEN 'C' ELSE 'F' END AS grade, round((value - 0.01) / (490.02 - 0.01), 6) AS share FROM events""")  # fmt: skip
def score_maps(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return rounded(t(spark, d, "events").select(
        "event_id", scores.linear_map(v, 100, -0.6).alias("line"), scores.piecewise(v, [(20, 100, -1.0), (80, 90, -0.5), (float("inf"), 40, -0.1)]).alias("pieces"),
        scores.grade(v, [(90, "A"), (75, "B"), (60, "C")], "F").alias("grade"), scores.share_between(v, 0.01, 490.02).alias("share")))


@query("odds_table", "MTH08", "MTH09", "MTH10", "SIM03", sql="""
WITH b AS (SELECT prediction_id, prob_home_f10 AS p, CASE WHEN edge_pct > 10 THEN -110 ELSE 150 END AS odds FROM predictions_2026 WHERE prob_home_f10 IS NOT NULL),
q AS (SELECT *, CASE WHEN odds > 0 THEN 1 + odds / 100.0 ELSE 1 + 100.0 / abs(odds) END::DOUBLE AS dec FROM b)
SELECT prediction_id, round(dec, 6) AS dec, round(CASE WHEN odds > 0 THEN 100.0 / (odds + 100) ELSE abs(odds) / (abs(odds) + 100.0) END, 6)::DOUBLE AS implied,
  round(greatest(0, ((dec - 1) * p - (1 - p)) / (dec - 1)), 6)::DOUBLE AS kelly, round((p * (dec - 1) - (1 - p)) * 100, 6) AS ev, round(1 / (1 + exp(-(p - 0.5) * 4)), 6) AS logit FROM q""")  # fmt: skip
def odds_table(spark: SparkSession, d: str) -> DataFrame:
    b = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null").select("prediction_id", F.col("prob_home_f10").alias("p"), F.when(F.col("edge_pct") > 10, -110).otherwise(150).alias("odds"))
    dec = scores.decimal_odds(F.col("odds"))
    return rounded(b.select("prediction_id", dec.alias("dec"), scores.implied_probability(F.col("odds")).alias("implied"), scores.growth_fraction(F.col("p"), dec).alias("kelly"),
                            scores.expected_value(F.col("p"), F.col("odds")).alias("ev"), scores.logistic((F.col("p") - 0.5) * 4).alias("logit")))
