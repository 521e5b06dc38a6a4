import random

from pyspark.sql import functions as F

from weftline.operators.impute import CategoryField, NumericField, fill_missing, filled_cells

SCHEMA = "id long, day date, team string, other string, x double, y double, src string, x_filled string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("day", F.col("day").cast("date"))


def fill(df):
    return fill_missing(df, "id", time="day", numerics=[NumericField("x", "team", (10, 200)), NumericField("y", "other", (10, 200))], categories=[CategoryField("src", ("team",))])


def test_every_stand_in_is_found(spark):
    import datetime as dt

    day = dt.date(2026, 1, 5)
    bad = [None, float("nan"), 0.0, -1.0, -99.0, 999.9, float("inf")]
    words = [None, "", "  ", "-", "?", "N/A", "n.a.", "none", "unknown"]
    rows = [(i, day, "a", "b", v, 70.0, "real", "clash") for i, v in enumerate(bad)] + [(100 + i, day, None, "b", 71.0, 70.0, w, "clash") for i, w in enumerate(words)]
    got = fill(table(spark, rows))
    cells = {(r["id"], r["field_name"]) for r in filled_cells(got, "id", ["x", "y", "src"]).collect()}
    assert cells == {(i, "x") for i in range(len(bad))} | {(100 + i, "src") for i in range(len(words))}
    assert got.count() == len(rows) and "x_filled_in" in got.columns
    assert got.filter("x_filled is null or src_filled is null").count() == 0


def test_held_out_values_come_back_close(spark):
    import datetime as dt

    rnd = random.Random(3)
    rows, truth = [], {}
    for i in range(1500):
        g = rnd.randrange(12)
        v = 60 + 2.5 * g + rnd.gauss(0, 1)
        c = "p" if (g < 6) ^ (rnd.random() < 0.1) else "q"
        hide, hide_c = rnd.random() < 0.1, rnd.random() < 0.1
        truth[i] = (v, c, hide, hide_c)
        rows.append((i, dt.date(2026, 1, 1) + dt.timedelta(days=i % 50), f"t{g}", f"t{g}", None if hide else v, 70.0 if False else (None if hide else v), "?" if hide_c else c, ""))
    out = {r["id"]: r for r in fill(table(spark, rows)).collect()}
    err = [abs(out[i]["x_filled"] - t[0]) for i, t in truth.items() if t[2]]
    base = [abs(t[0] - 73.75) for t in truth.values() if t[2]]
    assert sum(err) / len(err) < 1.5 < sum(base) / len(base)
    hit = [out[i]["src_filled"] == t[1] for i, t in truth.items() if t[3]]
    assert sum(hit) / len(hit) > 0.8
    assert all(out[i]["x_missing"] == t[2] for i, t in truth.items())


def test_nothing_known(spark):
    import datetime as dt

    got = fill(table(spark, [(1, dt.date(2026, 1, 1), "a", "a", None, None, None, "")])).collect()[0]
    assert got["x_filled"] is None and got["x_missing"] and got["src_filled"] is None and got["src_missing"]


def test_empty_table(spark):
    assert fill(table(spark, [])).count() == 0


def test_clashing_names_and_null_keys(spark):
    import datetime as dt

    rows = [(1, dt.date(2026, 1, 1), "a", "a", 50.0, 51.0, "p", ""), (2, dt.date(2026, 1, 2), "a", "b", None, 60.0, None, ""), (None, dt.date(2026, 1, 2), None, None, None, None, None, "")]
    df = table(spark, rows).withColumns({n: F.lit(7) for n in ("per", "grp", "eff", "k", "c", "_per", "_v", "_g0", "guess", "n")})
    got = {r["id"]: r for r in fill(df).collect()}
    assert len(got) == 3 and got[2]["x_filled"] is not None and got[2]["src_filled"] == "p" and got[None]["x_filled"] is not None and got[None]["src_filled"] == "p" and got[1]["_v"] == 7


def test_held_out_cells_of_the_real_table(spark):
    """A tenth of the real values is hidden: errors are smaller than those of the overall mean and of the commonest source."""
    import os

    import pytest

    from weftline.plans.p03_missing import PPG_RANGE
    from weftline.tables import load

    if not os.path.exists("/root/testdata/sf0.1"):
        pytest.skip("the test tables are not here")
    from weftline.operators.impute import number_missing, text_missing

    src = load(spark, "/root/testdata/sf0.1", "predictions_2026").select("prediction_id", "game_date", "home_team", "away_team", "home_ppg", "away_ppg", "stats_source")
    real = src.filter(~number_missing(F.col("home_ppg"), PPG_RANGE) & ~text_missing(F.col("stats_source")))
    hide = F.pmod(F.xxhash64("prediction_id"), F.lit(10)) == 0
    holed = src.join(real.select("prediction_id", F.lit(True).alias("ok")), "prediction_id", "left").withColumn("hid", hide & F.col("ok").isNotNull())
    given = holed.select("prediction_id", "game_date", "home_team", "away_team", F.when(~F.col("hid"), F.col("home_ppg")).alias("home_ppg"), "away_ppg", F.when(~F.col("hid"), F.col("stats_source")).alias("stats_source"))
    out = fill_missing(given, "prediction_id", time="game_date", numerics=[NumericField("home_ppg", "home_team", PPG_RANGE), NumericField("away_ppg", "away_team", PPG_RANGE)], categories=[CategoryField("stats_source", ("home_team", "away_team"))])
    x = out.select("prediction_id", "home_ppg_filled", "stats_source_filled").join(holed.filter("hid"), "prediction_id")
    mean = real.agg(F.avg("home_ppg")).first()[0]
    top = real.groupBy("stats_source").count().orderBy(F.desc("count")).first()[0]
    r = x.agg(F.avg(F.abs(F.col("home_ppg_filled") - F.col("home_ppg"))).alias("e"), F.avg(F.abs(F.lit(mean) - F.col("home_ppg"))).alias("b"),
              F.avg((F.col("stats_source_filled") == F.col("stats_source")).cast("double")).alias("a"), F.avg((F.col("stats_source") == top).cast("double")).alias("c")).first()
    print("held-out error of home_ppg", r["e"], "of the mean", r["b"], "; sources right", r["a"], "commonest", r["c"])
    assert r["e"] < 0.75 * r["b"] and r["a"] >= r["c"] - 0.02
