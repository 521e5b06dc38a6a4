"""p3: predictions with their missing cells filled from the same team or week."""

from pyspark.sql import DataFrame, SparkSession

from weftline.catalog import query
from weftline.operators.impute import CategoryField, NumericField, fill_missing, filled_cells
from weftline.tables import load

#: points a game that a team can average; anything else in these columns stands in for a missing value
PPG_RANGE = (10.0, 200.0)

P3_SQL = """
SELECT prediction_id, f AS field_name FROM (
  SELECT prediction_id, unnest([
    CASE WHEN home_ppg IS NULL OR isnan(home_ppg) OR home_ppg < 10 OR home_ppg > 200 THEN 'home_ppg' END,
    CASE WHEN away_ppg IS NULL OR isnan(away_ppg) OR away_ppg < 10 OR away_ppg > 200 THEN 'away_ppg' END,
    CASE WHEN stats_source IS NULL OR lower(trim(stats_source)) IN ('', '-', '--', '?', 'n/a', 'n.a.', 'na', 'nan', 'none', 'null', 'nil', 'unknown',
      'missing', 'tbd', 'not available') THEN 'stats_source' END]) AS f
  FROM predictions_2026)
WHERE f IS NOT NULL
"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = load(spark, sf_dir, "predictions_2026").select("prediction_id", "game_date", "home_team", "away_team", "home_ppg", "away_ppg", "stats_source")
    return fill_missing(
        src, "prediction_id", time="game_date", digits=1,
        numerics=[NumericField("home_ppg", "home_team", PPG_RANGE), NumericField("away_ppg", "away_team", PPG_RANGE)],
        categories=[CategoryField("stats_source", ("home_team", "away_team"))],
    )


@query("p3_found", sql=P3_SQL)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filled_cells(_filled(spark, sf_dir), "prediction_id", ["home_ppg", "away_ppg", "stats_source"])
    return cells.select("prediction_id", "field_name")


@query("p3_values")
def p3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell that was filled, with its value."""
    return filled_cells(_filled(spark, sf_dir), "prediction_id", ["home_ppg", "away_ppg", "stats_source"])


@query("p3_filled")
def p3_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir)
