"""p2: flat, linked tables out of deeply nested game payloads."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators.nested import flatten_json
from weftline.tables import load

P2_SQL = """
WITH whole AS (SELECT fetch_no, payload FROM season_pbp_2026 WHERE payload IS NOT NULL AND length(payload) > 0 AND json_valid(payload)),
opened AS (
  SELECT fetch_no, '' AS prefix, payload AS js FROM whole
  UNION ALL
  SELECT fetch_no, '.boxscore', payload->>'$.boxscore' FROM whole
  WHERE json_type(payload, '$.boxscore') = 'VARCHAR' AND json_valid(payload->>'$.boxscore')),
tree AS (
  SELECT o.fetch_no, regexp_replace(o.prefix || substr(t.fullkey, 2), '\\.participants(\\.|$)', '.participants[0]\\1', 'g') AS p, t.type
  FROM opened o, json_tree(o.js) t)
SELECT fetch_no, substr(p, 2) AS node_path FROM tree WHERE type = 'OBJECT' AND regexp_matches(p, '\\[[0-9]+\\]$')
"""


def _nodes(spark: SparkSession, sf_dir: str, body: bool) -> DataFrame:
    return flatten_json(load(spark, sf_dir, "season_pbp_2026"), "fetch_no", "payload", lone=["participants"], embedded=["boxscore"], body=body)


@query("p2_found", sql=P2_SQL)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, body=False).select("fetch_no", "node_path")


@query("p2_plays", sql="""
WITH w AS (SELECT fetch_no, payload FROM season_pbp_2026 WHERE payload IS NOT NULL AND payload <> '' AND json_valid(payload)),
p AS (SELECT fetch_no, e.key::INTEGER AS k, e.value AS j FROM w, json_each(payload, '$.plays') e WHERE json_type(payload, '$.plays') = 'ARRAY' AND json_type(e.value) = 'OBJECT')
SELECT fetch_no, 'plays[' || k || ']' AS node_path, k AS play_no, j->>'$.id' AS play_id, j->>'$.text' AS text, CASE WHEN json_type(j, '$.scoringPlay') = 'BOOLEAN' THEN (j->>'$.scoringPlay')::BOOLEAN END AS scoring_play,
  try_cast(j->>'$.scoreValue' AS INTEGER) AS score_value, try_cast(j->>'$.homeScore' AS INTEGER) AS home_score, try_cast(j->>'$.awayScore' AS INTEGER) AS away_score, try_cast(j->>'$.team.id' AS BIGINT) AS team_id, try_cast(j->>'$.period.number' AS INTEGER) AS period FROM p""")
def p2_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of plays; types that change between fetches are read as text and cast where they can be."""
    schema = "id string, sequenceNumber string, text string, scoringPlay boolean, scoreValue string, homeScore string, awayScore string, team struct<id:string>, period struct<number:string>"
    p = F.from_json("node_json", schema)
    return (
        _nodes(spark, sf_dir, body=True)
        .filter(F.col("array_path") == "plays")
        .select("fetch_no", "node_path", F.col("elem_no").alias("play_no"), p.alias("p"))
        .select(
            "fetch_no", "node_path", "play_no", F.col("p.id").alias("play_id"), F.col("p.text").alias("text"), F.col("p.scoringPlay").alias("scoring_play"),
            F.expr("try_cast(p.scoreValue as int)").alias("score_value"), F.expr("try_cast(p.homeScore as int)").alias("home_score"),
            F.expr("try_cast(p.awayScore as int)").alias("away_score"), F.expr("try_cast(p.team.id as bigint)").alias("team_id"),
            F.expr("try_cast(p.period.number as int)").alias("period"),
        )
    )


@query("p2_tables", sql=f"""
SELECT regexp_replace(node_path, '\\[[0-9]+\\]', '', 'g') AS array_path, count(*) AS n_rows, count_if(length(node_path) - length(replace(node_path, '[', '')) > 1) AS n_linked,
  max(regexp_extract(node_path, '\\[([0-9]+)\\]$', 1)::INTEGER) AS last_elem_no FROM ({P2_SQL}) GROUP BY 1""")
def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flat table there is, with the rows it has and the rows whose parent is itself a row."""
    return (
        _nodes(spark, sf_dir, body=False)
        .groupBy("array_path")
        .agg(F.count("*").alias("n_rows"), F.count("parent_path").alias("n_linked"), F.max("elem_no").alias("last_elem_no"))
    )
