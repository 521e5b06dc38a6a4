"""Simulations, baselines and models."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import models as M
from weftline.operators import simulate as S
from weftline.plans._util import r, rounded, t

_SEEDS = """WITH RECURSIVE s AS (SELECT (row_number() OVER (ORDER BY team_id) - 1)::BIGINT AS slot, avg_pts AS rating FROM (SELECT * FROM team_stats_2026 WHERE avg_pts IS NOT NULL ORDER BY team_id LIMIT 16))"""


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """The sixteen teams of the smallest ids as slots 0 to 15."""
    from pyspark.sql import Window

    s = t(spark, d, "team_stats_2026").filter("avg_pts is not null").orderBy("team_id").limit(16)
    return s.select((F.row_number().over(Window.orderBy("team_id")) - 1).cast("bigint").alias("slot"), F.col("avg_pts").alias("rating"))


@query("bracket_exact", "SIM01", "MTH10", sql=_SEEDS + """,
w AS (SELECT a.slot AS a, b.slot AS b, 1 / (1 + exp(-(a.rating - b.rating) / 11.0 * 1.7)) AS p FROM s a JOIN s b ON a.slot <> b.slot),
r1 AS (SELECT s.slot, w.p AS p FROM s JOIN w ON w.a = s.slot AND s.slot // 2 = w.b // 2),
r2 AS (SELECT x.slot, x.p * sum(y.p * w.p) AS p FROM r1 x JOIN r1 y ON x.slot // 4 = y.slot // 4 AND x.slot // 2 <> y.slot // 2 JOIN w ON w.a = x.slot AND w.b = y.slot GROUP BY x.slot, x.p),
r3 AS (SELECT x.slot, x.p * sum(y.p * w.p) AS p FROM r2 x JOIN r2 y ON x.slot // 8 = y.slot // 8 AND x.slot // 4 <> y.slot // 4 JOIN w ON w.a = x.slot AND w.b = y.slot GROUP BY x.slot, x.p),
r4 AS (SELECT x.slot, x.p * sum(y.p * w.p) AS p FROM r3 x JOIN r3 y ON x.slot // 8 <> y.slot // 8 JOIN w ON w.a = x.slot AND w.b = y.slot GROUP BY x.slot, x.p)
SELECT slot, 1 AS round, round(p, 6) AS p FROM r1 UNION ALL SELECT slot, 2, round(p, 6) FROM r2 UNION ALL SELECT slot, 3, round(p, 6) FROM r3 UNION ALL SELECT slot, 4, round(p, 6) FROM r4""")  # fmt: skip
def bracket_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.knockout_exact(_seeds(spark, d), "slot", "rating", 4, 11.0))


@query("bracket_simulated", "SIM01", "AGG33")
def bracket_simulated(spark: SparkSession, d: str) -> DataFrame:
    """Shares of 100,000 simulated knock-outs in which each team survives each round."""
    ratings = [x["rating"] for x in _seeds(spark, d).orderBy("slot").collect()]
    runs = S.knockout_runs(spark, ratings, 100_000, 11.0, 42)
    return rounded(runs.groupBy("slot", "round").agg((F.count("*") / F.lit(100_000.0)).alias("p")))


@query("bankroll_strategies", "SIM02", "SIM03", "AGG32")
def bankroll_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of staking strategies over repeated bets: median, spread and ruin."""
    sims = S.bankroll(spark, [(0.55, 1.91), (0.4, 2.8), (0.62, 1.7)], [1.0, 0.5, 0.25], sims=500, cycles=60, start=1000.0, ruin=10.0, seed=7)
    return rounded(sims.groupBy("strategy").agg(F.count("*").alias("n"), F.median("final").alias("median_final"), F.percentile("final", F.lit(0.05)).alias("p05"), F.avg(F.col("ruined").cast("int")).alias("ruin_rate")), 4)


@query("markov_generated", "STR14")
def markov_generated(spark: SparkSession, d: str) -> DataFrame:
    from weftline.functions.text import rejoin, words
    from weftline.operators.sequences import ngrams

    docs = t(spark, d, "documents").filter("text is not null")
    g = ngrams(docs, [], words(F.col("text")), 2).select(F.get("gram", F.lit(0)).alias("a"), F.get("gram", F.lit(1)).alias("b"))
    made = S.markov_text(g.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b", "n", ["the"], 60, 10, 11)
    return made.select("run", rejoin(F.col("tokens")).alias("text"))


@query("holdout_split", "SIM05")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return S.holdout(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42).groupBy("part").agg(F.count("*").alias("n"))


def _frame(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null and home_opp_ppg is not null and away_opp_ppg is not null and pace_ratio is not null")
    return p.select("prediction_id", "home_opp_ppg", "away_opp_ppg", "pace_ratio", "prob_home_f10", (F.col("prob_home_f10") > 0.5).cast("double").alias("y"))


_FEATURES = ["home_opp_ppg", "away_opp_ppg", "pace_ratio"]


@query("ols_slope", "ML02", "INF13", sql="""
SELECT count(*) AS n, round(regr_slope(prob_home_f10, home_opp_ppg), 6) AS slope, round(regr_intercept(prob_home_f10, home_opp_ppg), 6) AS intercept, round(regr_r2(prob_home_f10, home_opp_ppg), 6) AS r2
FROM predictions_2026 WHERE prob_home_f10 IS NOT NULL AND home_opp_ppg IS NOT NULL""")  # fmt: skip
def ols_slope(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null and home_opp_ppg is not null")
    return rounded(p.agg(F.count("*").alias("n"), F.regr_slope("prob_home_f10", "home_opp_ppg").alias("slope"), F.regr_intercept("prob_home_f10", "home_opp_ppg").alias("intercept"), F.regr_r2("prob_home_f10", "home_opp_ppg").alias("r2")))


@query("gbt_scores", "ML01")
def gbt_scores(spark: SparkSession, d: str) -> DataFrame:
    f = S.holdout(_frame(spark, d), "prediction_id", 0.3, 1)
    m = M.make_model("gbt_class", _FEATURES, "y").fit(f.filter("part = 'train'"))
    return M.scores(m, f.filter("part = 'test'")).select("prediction_id", r("score").alias("score"), "y")


@query("logistic_cv", "ML02", "ML03")
def logistic_cv(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities and their area under the ROC curve."""
    from weftline.operators.stats import rank_auc

    s = M.cross_validated(_frame(spark, d), "prediction_id", "logistic", _FEATURES, "y", 3)
    return rounded(rank_auc(s, "score", "y"))


@query("ablation", "ML05")
def ablation(spark: SparkSession, d: str) -> DataFrame:
    f = S.holdout(_frame(spark, d), "prediction_id", 0.3, 1)
    return rounded(M.ablation(f.filter("part = 'train'"), f.filter("part = 'test'"), "linear", _FEATURES, "prob_home_f10"))


@query("permutation_importance", "ML05")
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    f = S.holdout(_frame(spark, d), "prediction_id", 0.3, 1)
    m = M.make_model("ridge", _FEATURES, "prob_home_f10").fit(f.filter("part = 'train'"))
    return rounded(M.permutation_importance(m, f.filter("part = 'test'"), "prediction_id", _FEATURES, "prob_home_f10"))
