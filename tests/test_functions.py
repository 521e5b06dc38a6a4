"""Truth tables of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from weftline.functions import scores, text, times


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'date'}" for k, v in cols.items()))
    return df.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("y,p", [(-300, "Ptolemaic"), (-30, "Ptolemaic"), (-29, "Early Roman"), (100, "Early Roman"), (284, "Early Roman"), (285, "Late Roman"), (640, "Late Roman"), (641, "Late Roman"), (642, "Byzantine/Islamic"), (900, "Byzantine/Islamic")])
def test_period(spark, y, p):
    assert one(spark, times.period(F.col("y")), y=y) == p


def test_midpoint_and_decade(spark):
    assert one(spark, times.midpoint(F.col("a"), F.col("b")), a=-50, b=50) == 0
    assert one(spark, times.midpoint(F.col("a"), F.col("b")), a=-3, b=0) == -2
    assert [one(spark, times.decade(F.col("y")), y=y) for y in (-15, -10, 0, 9, 19)] == [-20, -10, 0, 0, 10]


@pytest.mark.parametrize("a,b,c,d,ok", [(100, 200, 150, 300, True), (100, 200, 250, 350, True), (100, 200, 701, 800, False), (1, 2, 1, 2, True), (-300, -200, -250, -150, True), (-300, -250, 200, 300, False)])
def test_overlap(spark, a, b, c, d, ok):
    got = one(spark, times.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 200), a=a, b=b, c=c, d=d)
    assert got is ok


@pytest.mark.parametrize("w,n", [("ζηνωνος", "ζηνων"), ("ζηνωνι", "ζηνων"), ("ζηνωνα", "ζηνων"), ("πτολεμαιου", "πτολεμαιος"), ("διονυσιου", "διονυσιος"), ("θεοδωρου", "θεοδωρος"), ("θεωνος", "θεων"), ("του", "του")])
def test_nominative(spark, w, n):
    assert one(spark, text.nominative(F.col("w")), w=w) == n


@pytest.mark.parametrize("h,t", [("<p>Hello <strong>world</strong></p>", "Hello world"), ("a &amp; b &lt;c&gt;", "a & b <c>"), ("  a\n\n b ", "a b"), ("", ""), (None, ""), ("&amp;lt;", "&lt;")])
def test_strip_markup(spark, h, t):
    assert one(spark, text.strip_markup(F.col("h")), h=h) == t


@pytest.mark.parametrize("p,q", [("articles.csv", "articles_highlights.csv"), ("a/b.c/articles.csv", "a/b.c/articles_highlights.csv"), ("noext", "noext_highlights")])
def test_beside(spark, p, q):
    assert one(spark, text.beside(F.col("p"), "_highlights"), p=p) == q


@pytest.mark.parametrize("s,v", [("72°F", 72.0), ("$1,105.2", 1105.2), ("+22.3K YoY", 22.3), ("none", None), ("", None)])
def test_decorated_number(spark, s, v):
    assert one(spark, text.decorated_number(F.col("s")), s=s) == v


def test_small_texts(spark):
    assert one(spark, text.drop_remark(F.col("s")), s="Oxyrhynchus (?)") == "Oxyrhynchus"
    assert one(spark, text.drop_remark(F.col("s")), s="Thebes (East) (?)") == "Thebes"
    assert one(spark, text.drop_remark(F.col("s")), s="(?)") == "(?)"
    assert one(spark, text.old_spelling(F.col("s")), s=" Cæsar ꝛex uulgus ") == "caesar rex vvlgvs"
    assert one(spark, text.signs(F.col("s")), s="ku-ro₂-*301-5-") == ["ku", "ro", "UNK"]
    assert one(spark, text.rejoin(text.words(F.col("s"))), s="hello there. how ARE you?") == "Hello there. How are you?"
    assert one(spark, text.person_name(F.col("s")), s=" [Zenon &amp; Co.], ") == "Zenon & Co"
    assert one(spark, text.name_key(F.col("s")), s=" St. Kipquay") == "st"
    assert one(spark, text.piped(F.col("s")), s="http://x | T | | f").asDict() == {"url": "http://x", "title": "T", "description": None, "folder": "f"}
    assert one(spark, text.capitalised(F.col("s")), s="Der Peter Paul sah Peter Paul in Ur") == ["Der Peter Paul", "Peter Paul"]
    assert one(spark, text.levenshtein_ratio(F.col("s"), F.lit("abcd")), s="abcx") == 0.75


def chunks(spark, a, b):
    return [(r["month"], r["first_day"], r["last_day"]) for r in one(spark, times.month_chunks(F.col("a"), F.col("b")), a=a, b=b)]


def test_month_chunks(spark):
    d = dt.date
    assert chunks(spark, d(2024, 1, 1), d(2024, 3, 31)) == [("2024-01", d(2024, 1, 1), d(2024, 1, 31)), ("2024-02", d(2024, 2, 1), d(2024, 2, 29)), ("2024-03", d(2024, 3, 1), d(2024, 3, 31))]
    assert chunks(spark, d(2023, 5, 17), d(2023, 7, 9))[0] == ("2023-05", d(2023, 5, 17), d(2023, 5, 31))
    assert len(chunks(spark, d(2024, 1, 1), d(2026, 7, 25))) == 31
    assert chunks(spark, d(2024, 1, 5), d(2024, 1, 5)) == [("2024-01", d(2024, 1, 5), d(2024, 1, 5))]
    with pytest.raises(Exception, match="ends before"):
        chunks(spark, d(2024, 2, 1), d(2024, 1, 1))


def test_hours_and_dates(spark):
    for s in ("2026-01-05T07", "2026-01-05T07:30", "2026-01-05 07:59:59"):
        assert one(spark, times.hour_key(F.col("s")), s=s) == dt.datetime(2026, 1, 5, 7)
    assert one(spark, times.hour_key(F.col("s")), s="soon") is None
    assert one(spark, times.local_hour(F.to_timestamp("s"), -8), s="2026-01-05 03:00:00") == 19
    assert one(spark, times.mail_date(F.col("s")), s="Mon, 05 Jan 2026 10:00:00 +0000") == dt.datetime(2026, 1, 5, 10)
    assert one(spark, times.mail_date(F.col("s")), s="yesterday") is None
    assert one(spark, times.tolerant_date(F.col("s")), s="2026-01-05 and more") == dt.date(2026, 1, 5)


def test_scores(spark):
    x = F.col("x")
    assert one(spark, scores.clamp(x), x=120.0) == 100.0
    assert one(spark, scores.linear_map(x, 100, -0.6), x=42.0) == pytest.approx(74.8)
    assert one(spark, scores.decimal_odds(x), x=-110.0) == pytest.approx(1 + 100 / 110)
    assert one(spark, scores.implied_probability(x), x=150.0) == pytest.approx(0.4)
    assert one(spark, scores.growth_fraction(x, F.lit(2.0)), x=0.6) == pytest.approx(0.2)
    assert one(spark, scores.growth_fraction(x, F.lit(2.0)), x=0.4) == 0.0
    assert one(spark, scores.american_odds(x), x=0.75) == -300.0
    assert one(spark, scores.grade(x, [(90, "A"), (75, "B")], "F"), x=75.0) == "B"
    assert one(spark, scores.composite(x, F.lit(None).cast("double")), x=0.0) == 0.0
    assert one(spark, scores.safe_ratio(x, F.lit(0.0), 0.5), x=3.0) == 0.5
