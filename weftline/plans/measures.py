"""Feature sets, lookups, grades, arrays, gates and simulations, each with a twin."""

import gzip

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import scores
from weftline.functions import text as X
from weftline.operators import quality as D
from weftline.operators import relational as R
from weftline.operators import sequences as Q
from weftline.operators import simulate as M
from weftline.operators import stats as I
from weftline.plans._util import DAILY, daily, r, rounded, t
from weftline.plans.feeds import _local, folder
from weftline.sinks import files as K

# -- features of a pair of teams -------------------------------------------------------------------------------------------

_DIM = """dim AS (SELECT team_name, arg_min(coalesce(avg_pts, 70.0), team_id) AS f, arg_min(coalesce(avg_opp_pts, 70.0), team_id) AS g, arg_min(coalesce(avg_pace, 68.0), team_id) AS p FROM team_stats_2026 WHERE team_name IS NOT NULL GROUP BY 1),
m AS (SELECT prediction_id, coalesce(h.f, 70.0) AS hf, coalesce(h.g, 70.0) AS hg, coalesce(h.p, 68.0) AS hp, coalesce(a.f, 70.0) AS af, coalesce(a.g, 70.0) AS ag, coalesce(a.p, 68.0) AS ap
  FROM predictions_2026 LEFT JOIN dim h ON h.team_name = home_team LEFT JOIN dim a ON a.team_name = away_team)"""


def _matchups(spark: SparkSession, d: str) -> DataFrame:
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    dim = R.keep_first(t(spark, d, "team_stats_2026").filter("team_name is not null").select("team_name", "team_id", z("avg_pts", 70.0), z("avg_opp_pts", 70.0), z("avg_pace", 68.0)), ["team_name"], ["team_id"])
    m = t(spark, d, "predictions_2026").select("prediction_id", "home_team", "away_team")
    for side, p in (("home_team", "h"), ("away_team", "a")):
        m = R.lookup(m, dim.drop("team_id"), {side: "team_name"}, {"avg_pts": 70.0, "avg_opp_pts": 70.0, "avg_pace": 68.0})
        m = m.withColumnsRenamed({"avg_pts": f"{p}f", "avg_opp_pts": f"{p}g", "avg_pace": f"{p}p"})
    return m


@query("pair_features", "PRJ01", sql=f"""
WITH {_DIM} SELECT prediction_id, round(hf, 6) AS home_for, round(af, 6) AS away_for, round(hg, 6) AS home_against, round(ag, 6) AS away_against, CASE WHEN hp + ap > 0 THEN round(hp / (hp + ap), 6) ELSE 0.5 END AS pace_share,
  round(hf - af, 6) AS diff, round(hf + af, 6) AS total, round(hf - hg, 6) AS home_net, round(af - ag, 6) AS away_net, 53.0::DOUBLE AS home_tempo, 53.0::DOUBLE AS away_tempo, 0.0::DOUBLE AS tempo_diff FROM m""")  # fmt: skip
def pair_features(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rounded(_matchups(spark, d).select("prediction_id", *scores.pair_features(c("hf"), c("af"), c("hg"), c("ag"), c("hp"), c("ap"), F.lit(53.0), F.lit(53.0))))


@query("totals_features", "PRJ02", sql=f"""
WITH {_DIM} SELECT prediction_id, round(hf, 6) AS home_for, round(af, 6) AS away_for, round(hg, 6) AS home_against, round(ag, 6) AS away_against, round(hf + af, 6) AS total, round(hf - hg, 6) AS home_net, round(af - ag, 6) AS away_net,
  round((hf - hg + af - ag) / 2, 6) AS mean_net, round((hg + ag) / 2, 6) AS mean_against FROM m""")  # fmt: skip
def totals_features(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return rounded(_matchups(spark, d).select("prediction_id", *scores.totals_features(c("hf"), c("af"), c("hg"), c("ag"))))


@query("both_orientations", "PRJ04", sql=f"""
WITH {_DIM}, p AS (SELECT prediction_id, 1 / (1 + exp(-((hf - af) / 10 + 0.2))) AS p1, 1 / (1 + exp(-((af - hf) / 10 + 0.2))) AS p2 FROM m)
SELECT prediction_id, round((p1 + 1 - p2) / 2, 6) AS p FROM p""")  # fmt: skip
def both_orientations(spark: SparkSession, d: str) -> DataFrame:
    """A model that favours the side named first, freed of that by averaging both orientations."""
    model = lambda x, y: scores.logistic((x - y) / 10 + 0.2)
    return _matchups(spark, d).select("prediction_id", r(scores.both_ways(model(F.col("hf"), F.col("af")), model(F.col("af"), F.col("hf")))).alias("p"))


@query("key_fallback", "PRJ09", "SET01", sql="""
SELECT 'team' AS kind, team_id AS id, coalesce(team_name, 'TBD') AS name FROM team_stats_2026 UNION ALL SELECT 'listed', book_team_id, coalesce(nickname, home_city, listed_name, 'TBD') FROM book_teams""")  # fmt: skip
def key_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two shapes: the first of several keys that a row has names it."""
    a = t(spark, d, "team_stats_2026").select(F.lit("team").alias("kind"), F.col("team_id").alias("id"), "team_name")
    b = t(spark, d, "book_teams").select(F.lit("listed").alias("kind"), F.col("book_team_id").alias("id"), "nickname", "home_city", "listed_name")
    return a.unionByName(b, allowMissingColumns=True).select("kind", "id", F.coalesce("team_name", "nickname", "home_city", "listed_name", F.lit("TBD")).alias("name"))


# -- periods ---------------------------------------------------------------------------------------------------------------------


@query("period_rows", "FIL17", sql=f"WITH {DAILY} SELECT event_type, 'M' || strftime(day, '%m') AS period, round(avg(v), 5) AS value FROM daily GROUP BY ALL")
def period_rows(spark: SparkSession, d: str) -> DataFrame:
    """Monthly rows beside a yearly one marked M13: only the months stay."""
    v = daily(spark, d)
    month = v.groupBy("event_type", F.concat(F.lit("M"), F.date_format("day", "MM")).alias("period")).agg(F.avg("v").alias("value"))
    both = month.unionByName(v.groupBy("event_type").agg(F.lit("M13").alias("period"), F.avg("v").alias("value")))
    return both.filter(F.col("period").rlike("^M(0[1-9]|1[0-2])$")).withColumn("value", r("value", 5))


@query("weekly_to_monthly", "AGG19", sql=f"""
WITH {DAILY}, w AS (SELECT event_type, date_trunc('week', day)::DATE AS week, avg(v) AS v FROM daily GROUP BY ALL)
SELECT event_type, strftime(week, '%Y-%m') AS month, round(avg(round(v, 4)), 8) AS value, count(*) AS n_weeks FROM w WHERE week(week) % 4 <> 0 GROUP BY ALL""")  # fmt: skip
def weekly_to_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly texts, every fourth of them a full stop, as monthly means of what can be read."""
    w = daily(spark, d).groupBy("event_type", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.avg("v").alias("v"))
    text = F.when(F.weekofyear("week") % 4 == 0, ".").otherwise(r("v", 4).cast("string"))
    ok = w.select("event_type", "week", text.try_cast("double").alias("x")).filter("x is not null")
    return ok.groupBy("event_type", F.date_format("week", "yyyy-MM").alias("month")).agg(r(F.avg("x"), 8).alias("value"), F.count("*").alias("n_weeks"))


# -- lookups -----------------------------------------------------------------------------------------------------------------------


@query("alias_lookup", "JON19", sql="""
WITH a AS (SELECT nickname, min(full_name) AS full_name FROM name_nicknames WHERE nickname IS NOT NULL GROUP BY 1),
w AS (SELECT person_id, string_split(canonical_name, ' ')[1] AS first FROM canonical_persons WHERE canonical_name IS NOT NULL)
SELECT person_id, coalesce(full_name, first) AS name, full_name IS NOT NULL AS by_alias FROM w LEFT JOIN a ON nickname = first""")  # fmt: skip
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    """First names with by-names replaced through an alias table."""
    a = t(spark, d, "name_nicknames").filter("nickname is not null").groupBy("nickname").agg(F.min("full_name").alias("full_name"))
    w = t(spark, d, "canonical_persons").filter("canonical_name is not null").select("person_id", F.split_part("canonical_name", F.lit(" "), F.lit(1)).alias("first"))
    return w.join(a, F.col("first") == F.col("nickname"), "left").select("person_id", F.coalesce("full_name", "first").alias("name"), F.col("full_name").isNotNull().alias("by_alias"))


@query("priced_predictions", "JON24", sql="""
WITH o AS (SELECT team_name, arg_min(CASE WHEN games % 2 = 0 THEN 150 ELSE -110 END, team_id) AS odds FROM team_stats_2026 WHERE games IS NOT NULL AND team_name IS NOT NULL GROUP BY 1)
SELECT prediction_id, odds::INTEGER AS odds, round(prob_home_f10 - CASE WHEN odds > 0 THEN 100.0 / (odds + 100) ELSE abs(odds) / (abs(odds) + 100.0) END, 6)::DOUBLE AS edge
FROM predictions_2026 JOIN o ON team_name = home_team WHERE prob_home_f10 IS NOT NULL""")  # fmt: skip
def priced_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that have a price, and by how much they differ from it."""
    o = t(spark, d, "team_stats_2026").filter("games is not null and team_name is not null").select("team_name", "team_id", F.when(F.col("games") % 2 == 0, 150).otherwise(-110).alias("odds"))
    o = R.keep_first(o, ["team_name"], ["team_id"])
    p = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null").join(o, F.col("team_name") == F.col("home_team"))
    return p.select("prediction_id", "odds", r(F.col("prob_home_f10") - scores.implied_probability(F.col("odds"))).alias("edge"))


_EVENT_PAIRS = "e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)"


@query("followers_of", "JON25", sql=f"""
WITH {_EVENT_PAIRS}, j AS (SELECT user_id, event_type AS a, nxt AS b, count(*) AS n FROM e WHERE nxt IS NOT NULL GROUP BY ALL),
dom AS (SELECT user_id, a, arg_min(b, (-n, b)) AS b FROM j GROUP BY ALL) SELECT b AS leader, a AS follower, count(*) AS n_users FROM dom GROUP BY ALL""")  # fmt: skip
def followers_of(spark: SparkSession, d: str) -> DataFrame:
    """For every kind of event the kinds it is the commonest successor of, by the number of users of whom that holds."""
    g = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))  # the events of one user
    p = Q.ngrams(g, ["user_id"], F.transform("l", lambda x: x["event_type"]), 2).select("user_id", F.get("gram", F.lit(0)).alias("a"), F.get("gram", F.lit(1)).alias("b"))
    j = p.groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))
    dom = j.groupBy("user_id", "a").agg(F.min_by("b", F.struct(-F.col("n"), F.col("b"))).alias("leader"))
    return dom.groupBy("leader", F.col("a").alias("follower")).agg(F.count("*").alias("n_users"))


@query("membership_label", "JON26", sql="""
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.09) THEN 'returned' ELSE 'other' END AS label FROM part""")  # fmt: skip
def membership_label(spark: SparkSession, d: str) -> DataFrame:
    """Rows labelled by whether they are members of a set from elsewhere."""
    s = t(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_partkey").alias("k"), F.lit(True).alias("m")).distinct()
    return t(spark, d, "part").join(s, F.col("p_partkey") == F.col("k"), "left").select("p_partkey", F.when(F.col("m"), "returned").otherwise("other").alias("label"))


@query("stage_reach", "AGG33", sql="""
WITH u AS (SELECT user_id, count(DISTINCT event_type) AS k, array_to_string(list_sort(list_distinct(list(event_type))), '+') AS combo FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM u)
SELECT 'stage ' || s AS what, round(count_if(k >= s) / any_value(n), 6)::DOUBLE AS share FROM u, n, range(1, 6) v(s) GROUP BY s UNION ALL SELECT 'combo ' || combo, round(count(*) / any_value(n), 6)::DOUBLE FROM u, n GROUP BY combo""")  # fmt: skip
def stage_reach(spark: SparkSession, d: str) -> DataFrame:
    """Of all users the share that reaches each number of kinds of events, and the share of each combination."""
    u = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("s"))
    n = u.count()
    stage = u.select(F.explode(F.sequence(F.lit(1), F.size("s"))).alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    stage = spark.range(1, 6).join(stage, F.col("id") == F.col("k"), "left").select(F.concat(F.lit("stage "), F.col("id").cast("string")).alias("what"), F.coalesce("c", F.lit(0)).alias("c"))
    combo = u.groupBy(F.concat(F.lit("combo "), F.array_join("s", "+")).alias("what")).agg(F.count("*").alias("c"))
    return stage.unionByName(combo).select("what", r(F.col("c") / F.lit(float(max(n, 1)))).alias("share"))


# -- grades and units ------------------------------------------------------------------------------------------------------------------


@query("graded", "MTH04", "MTH05", "MTH11", "MTH12", "MTH17", sql="""
WITH k AS (SELECT event_id, value, CASE WHEN event_id % 10 <> 0 THEN value END AS a, CASE WHEN event_id % 7 <> 0 THEN 100 - value END AS b FROM events)
SELECT event_id, CASE WHEN a IS NULL THEN '?' WHEN a >= 90 THEN 'A' WHEN a >= 75 THEN 'B' WHEN a >= 60 THEN 'C' WHEN a >= 40 THEN 'D' ELSE 'F' END AS grade,
  round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END, 6) AS both, round(least(0.75, greatest(0.3, 0.5 + (value - 50) * 0.02)), 6)::DOUBLE AS p,
  round(least(75, greatest(30, 50 + (value - 50) * 2)), 6)::DOUBLE AS pct, round(value * 0.95, 6) AS damped, round(value / 1000, 9) AS watts FROM k""")  # fmt: skip
def graded(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    a, b = F.when(F.col("event_id") % 10 != 0, v), F.when(F.col("event_id") % 7 != 0, 100 - v)
    return t(spark, d, "events").select(
        "event_id", scores.grade(a, [(90, "A"), (75, "B"), (60, "C"), (40, "D")], "F").alias("grade"), r(scores.composite(a, b)).alias("both"),
        r(scores.linear_map(v - 50, 0.5, 0.02, 0.3, 0.75)).alias("p"), r(scores.linear_map(v - 50, 50, 2, 30, 75)).alias("pct"), r(scores.damped(v, 0.95)).alias("damped"), r(scores.milli(v), 9).alias("watts"),
    )


@query("fair_odds", "MTH07", "STR17", sql="""
WITH k AS (SELECT prediction_id, round(prob_home_f10, 4) AS p FROM predictions_2026 WHERE prob_home_f10 IS NOT NULL),
o AS (SELECT prediction_id, CASE WHEN p <= 0 OR p >= 1 THEN NULL WHEN p >= 0.5 THEN -round(100 * p / (1 - p)) ELSE round(100 * (1 - p) / p) END AS odds FROM k)
SELECT prediction_id, odds, CASE WHEN odds > 0 THEN round(1 + odds / 100, 6) ELSE round(1 + 100 / abs(odds), 6) END AS back, CASE WHEN odds IS NOT NULL THEN printf('%+.0f', odds) END AS shown FROM o""")  # fmt: skip
def fair_odds(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities as American odds, back as decimal ones, and as they are written."""
    o = t(spark, d, "predictions_2026").filter("prob_home_f10 is not null").select("prediction_id", scores.american_odds(F.round("prob_home_f10", 4)).alias("odds"))
    return o.select("prediction_id", "odds", r(scores.decimal_odds(F.col("odds"))).alias("back"), F.when(F.col("odds").isNotNull(), F.format_string("%+.0f", F.col("odds"))).alias("shown"))


# -- arrays ----------------------------------------------------------------------------------------------------------------------------


@query("array_work", "ARR09", "ARR10", sql="""
WITH k AS (SELECT row_no, list_sort(list_distinct(list_filter(list_concat(coalesce(explicit_names, []), coalesce(person_names, [])), lambda x: x IS NOT NULL))) AS l FROM papyri_documents)
SELECT row_no, len(l)::INTEGER AS n, array_to_string(l[1:3], '|') AS first_three FROM k""")  # fmt: skip
def array_work(spark: SparkSession, d: str) -> DataFrame:
    """Two lists merged, sorted and without repeats, and the first three of them."""
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_compact(F.array_union(F.coalesce("explicit_names", none), F.coalesce("person_names", none))))
    return t(spark, d, "papyri_documents").select("row_no", F.size(merged).alias("n"), F.array_join(F.slice(merged, 1, 3), "|").alias("first_three"))


@query("element_by_key", "ARR02", sql="""
SELECT run_no, list_filter(places.top_30_places, lambda x: x.doc_count = list_max(list_transform(places.top_30_places, lambda y: y.doc_count)))[1].place AS top_place,
  coalesce(list_filter(places.top_30_places, lambda x: x.place = 'nowhere')[1].doc_count, -1)::INTEGER AS nowhere FROM metadata_analysis_v2""")  # fmt: skip
def element_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The element of an array that has a given key, and a default where none has."""
    l = F.col("places.top_30_places")  # noqa: E741
    most = F.array_max(F.transform(l, lambda y: y["doc_count"]))
    return t(spark, d, "metadata_analysis_v2").select(
        "run_no", F.get(F.filter(l, lambda x: x["doc_count"] == most), F.lit(0))["place"].alias("top_place"), F.coalesce(F.get(F.filter(l, lambda x: x["place"] == "nowhere"), F.lit(0))["doc_count"], F.lit(-1)).cast("int").alias("nowhere")
    )


# -- gates, healing, snapshots ---------------------------------------------------------------------------------------------------------


@query("file_gate", "DQ04", "STM06", sql="""
SELECT * FROM (VALUES ('damaged', 'damaged'), ('list', NULL), ('object', NULL), ('plain', 'not gzip'), ('words', 'no JSON'), ('gone', 'missing'), ('gate', 'closed')) v(file, problem)""")  # fmt: skip
def file_gate(spark: SparkSession, d: str) -> DataFrame:
    """Five files judged by unpacking them whole, one that is expected but not there, and the gate that they close."""
    at = _local(folder(spark, "gate"))
    whole = gzip.compress(b'{"a": 1}', mtime=0)
    for name, body in {"object": whole, "list": gzip.compress(b"[1, 2]", mtime=0), "plain": b'{"a": 1}', "damaged": whole[:-6], "words": gzip.compress(b"no object", mtime=0)}.items():
        (at / f"{name}.json.gz").write_bytes(body)
    found = D.file_problems(spark.read.format("binaryFile").load(str(at))).select(F.regexp_extract("path", r"([a-z]+)\.json\.gz$", 1).alias("file"), "problem")
    expected = spark.createDataFrame([(n,) for n in ("object", "list", "plain", "damaged", "words", "gone")], "file string")
    return D.gate(expected, found, "file", "problem")


@query("healed_window", "STM04", sql=f"""
WITH {DAILY}, x AS (SELECT max(day) AS last FROM daily), g AS (SELECT unnest(generate_series(last - INTERVAL 9 DAY, last, INTERVAL 1 DAY))::TIMESTAMP AS day FROM x), k AS (SELECT DISTINCT event_type FROM daily)
SELECT g.day::DATE AS day, k.event_type, day(g.day) % 3 = 0 AS healed, round(v, 5) AS v FROM g CROSS JOIN k JOIN daily USING (day, event_type)""")  # fmt: skip
def healed_window(spark: SparkSession, d: str) -> DataFrame:
    """The last ten days ensured again: days that earlier runs missed (every third) are fetched, the others kept."""
    source = daily(spark, d).withColumn("day", F.to_date("day"))
    have = source.filter(F.dayofmonth("day") % 3 != 0)
    last = source.agg(F.max("day")).first()[0]
    got = D.heal(have, source, ["day", "event_type"], "day", last, 10)
    return got.select("day", "event_type", "healed", r("v", 5).alias("v"))


@query("snapshot_trend", "STM07", sql="""
SELECT event_type, count(*) AS n_first, count(*) + 1 AS n_last, 1::BIGINT AS delta, 2::BIGINT AS snapshots FROM events GROUP BY 1""")  # fmt: skip
def snapshot_trend(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots appended to one file set, and the trend read off all of them."""
    at = folder(spark, "snapshots")
    now = t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    K.append_jsonl(now.withColumn("taken", F.lit("2026-01-01")), at)
    K.append_jsonl(now.withColumn("n", F.col("n") + 1).withColumn("taken", F.lit("2026-01-02")), at)
    all_ = spark.read.schema("event_type string, n bigint, taken string").json(at)
    g = all_.groupBy("event_type").agg(F.min_by("n", "taken").alias("n_first"), F.max_by("n", "taken").alias("n_last"), F.count("*").alias("snapshots"))
    return g.select("event_type", "n_first", "n_last", (F.col("n_last") - F.col("n_first")).alias("delta"), "snapshots")


@query("manifest_repair", "DQ06", sql="""
WITH m AS (SELECT n_nationkey::BIGINT AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'missing' END AS s FROM nation WHERE n_nationkey <> 24), f AS (SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey % 3 = 0)
SELECT coalesce(m.k, f.k) AS k, CASE WHEN f.k IS NOT NULL THEN 'ok' ELSE 'missing' END AS s, m.s IS DISTINCT FROM CASE WHEN f.k IS NOT NULL THEN 'ok' ELSE 'missing' END AS changed FROM m FULL JOIN f USING (k)""")  # fmt: skip
def manifest_repair(spark: SparkSession, d: str) -> DataFrame:
    """A manifest brought in line with the files that are there."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    m = n.filter("k <> 24").withColumn("s", F.when(F.col("k") % 2 == 0, "ok").otherwise("missing"))
    return D.repair(m, n.filter("k % 3 = 0"), "k", "s")


# -- walks through a model of any order -------------------------------------------------------------------------------------------------


@query("markov_order_two", "SIM04", sql="SELECT i AS run, 40::INTEGER AS n, true AS known FROM range(20) v(i)")
def markov_order_two(spark: SparkSession, d: str) -> DataFrame:
    """Twenty walks of forty words through a model of pairs of words: every step is one that the texts take, but for jumps."""
    docs = t(spark, d, "documents").filter("text is not null")
    g = Q.ngrams(docs, [], X.letters_words(F.lower("text")), 3).select(F.array_join(F.slice("gram", 1, 2), " ").alias("a"), F.element_at("gram", -1).alias("b"))
    model = g.groupBy("a", "b").agg(F.count("*").alias("n"))
    made = M.markov_text(model, "a", "b", "n", [], 40, 20, 5, order=2)
    words = g.select(F.col("b").alias("w")).union(g.select(F.explode(F.split("a", " ")).alias("w"))).distinct()
    known = made.select("run", F.explode("tokens").alias("w")).join(words.withColumn("k", F.lit(1)), "w", "left").groupBy("run").agg(F.count("*").cast("int").alias("n"), F.count("k").cast("int").alias("m"))
    return known.select("run", "n", (F.col("n") == F.col("m")).alias("known"))


@query("holdout_sizes", "SIM05", sql="SELECT count(*) AS n, true AS fair FROM orders")
def holdout_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable fifth held out: all rows are in one part, and the share is near what was asked for."""
    h = M.holdout(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42).agg(F.count("*").alias("n"), F.avg((F.col("part") == "test").cast("int")).alias("p"))
    return h.select("n", F.col("p").between(0.15, 0.25).alias("fair"))


@query("next_event_entropy", "INF02", sql="""
WITH k AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), j AS (SELECT a, b, count(*) AS n FROM k WHERE b IS NOT NULL GROUP BY ALL),
m AS (SELECT a, sum(n) AS m, sum(n * log2(n)) AS s FROM j GROUP BY 1) SELECT sum(m)::BIGINT AS total, round(sum(m * log2(m) - s) / sum(m), 6) AS cond_entropy FROM m""")  # fmt: skip
def next_event_entropy(spark: SparkSession, d: str) -> DataFrame:
    """How far a user's event tells the next one."""
    g = t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("l"))  # the events of one user
    p = Q.ngrams(g, [], F.transform("l", lambda x: x["event_type"]), 2).select(F.get("gram", F.lit(0)).alias("a"), F.get("gram", F.lit(1)).alias("b"))
    h = I.conditional_entropy(p, [], "a", "b")
    return h.crossJoin(p.agg(F.count("*").alias("total"))).select("total", r("cond_entropy").alias("cond_entropy"))
