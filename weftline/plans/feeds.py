"""Every source and sink on real rows: a table is written in a format and read back, and the twin reads the table itself."""

import io
import json
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.functions import text as X
from weftline.functions import times
from weftline.plans._util import DAILY, daily, r, t
from weftline.session import ensure_checkpoint_dir
from weftline.sinks import files as K
from weftline.sources import files as S
from weftline.sources import readers


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> Path:
    """The same folder as a path of the shared file system, for sources that open files themselves."""
    p = Path(path.removeprefix("file://").removeprefix("file:"))
    p.mkdir(parents=True, exist_ok=True)
    return p


def _one_text(df: DataFrame, path: str) -> str:
    """A small table of one text column as one file."""
    df.coalesce(1).write.text(path)
    return path


def _nation(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation")


# -- CSV -------------------------------------------------------------------------------------------------------------------------


@query("feed_csv_typed", "SRC01", "SRC04", "SNK01", sql="SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::INTEGER AS c_nationkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def feed_csv_typed(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "typed")
    K.csv_parts(t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), at)
    return S.csv_table(spark, at, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double").withColumn("c_acctbal", r("c_acctbal", 2))


@query("feed_csv_dated", "SRC02", "SNK03", sql=f"WITH {DAILY} SELECT day::DATE AS day, event_type, CASE WHEN event_type <> 'click' THEN round(v, 5) END AS v FROM daily")
def feed_csv_dated(spark: SparkSession, d: str) -> DataFrame:
    """A dated series with unreadable cells, which come back as nulls."""
    at = folder(spark, "dated")
    cell = F.when(F.col("event_type") == "click", "n/a").otherwise(r("v", 5).cast("string"))
    K.csv_parts(daily(spark, d).select(F.to_date("day").alias("day"), "event_type", cell.alias("v")), at)
    return S.csv_dated(spark, at, "day", {"event_type": "string", "v": "double"})


@query("feed_csv_texts", "SRC03", "SNK02", sql="SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_acctbal > 0 THEN '1' ELSE '0' END AS solvent FROM supplier")
def feed_csv_texts(spark: SparkSession, d: str) -> DataFrame:
    """Ordered rows with flags as 1 and 0, read back as texts."""
    at = folder(spark, "texts")
    K.csv_report(t(spark, d, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") > 0).alias("solvent")), at, ["s_suppkey"])
    return S.csv_text(spark, at)


# -- JSON ------------------------------------------------------------------------------------------------------------------------


@query("feed_json_map", "SRC05", "SNK04", sql="SELECT team_id::VARCHAR AS id, team_name, games::INTEGER AS games FROM team_stats_2026")
def feed_json_map(spark: SparkSession, d: str) -> DataFrame:
    """One document {id: {...}} of the fixed list of teams."""
    one = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("team_id").cast("string"), F.struct("team_name", "games")))))
    at = _one_text(t(spark, d, "team_stats_2026").agg(one.alias("value")), folder(spark, "map"))
    return S.json_map(spark, at, "struct<team_name: string, games: int>")


_HOURS = "SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, event_type, avg(value) AS v FROM events GROUP BY ALL"


@query("feed_json_series", "SRC06", "SRC07", sql=f"SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS time, event_type, round(v, 5) AS v FROM ({_HOURS})")
def feed_json_series(spark: SparkSession, d: str) -> DataFrame:
    """Gzip-ed files of parallel hourly arrays, one a type and month (a few hundred hours each); an archive that is not there adds nothing."""
    h = t(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("ts"), "event_type").agg(F.avg("value").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("ts", "v")))
    doc = h.groupBy("event_type", F.date_format("ts", "yyyyMM").alias("month")).agg(pairs.alias("p"))
    hourly = F.struct(F.transform("p", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.transform("p", lambda x: x["v"]).alias("v"))
    at = folder(spark, "series")
    doc.select("event_type", "month", F.to_json(F.struct(hourly.alias("hourly"))).alias("value")).repartition("event_type", "month").write.partitionBy("event_type", "month").option("compression", "gzip").text(at)
    got = S.json_series(spark, f"{at}/*/*/*.gz", ["v"])
    gone = S.if_present(spark, f"{at}/none/*.gz", lambda s, p: S.json_series(s, p, ["v"]), "file string, pos int, time string, v double")
    return got.unionByName(gone).select("time", F.regexp_extract("file", "event_type=([^/]+)", 1).alias("event_type"), r("v", 5).alias("v"))


@query("feed_market_hours", "SRC08", sql="""
SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, round(arg_max(value, event_id), 5) AS price FROM (
  SELECT *, max(ts) OVER (PARTITION BY date_trunc('hour', ts)) AS m FROM events WHERE event_type = 'purchase') WHERE ts = m GROUP BY 1""")  # fmt: skip
def feed_market_hours(spark: SparkSession, d: str) -> DataFrame:
    """A file a day; the last row of an hour counts."""
    e = t(spark, d, "events").filter("event_type = 'purchase'").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    doc = F.struct(F.transform(rows, lambda x: F.struct(F.date_format(x["ts"], "yyyy-MM-dd HH:mm:ss").alias("start_gmt"), x["value"].cast("string").alias("price"))).alias("rows"))
    at = folder(spark, "market")
    e.groupBy("day").agg(F.to_json(doc).alias("value")).repartition("day").write.partitionBy("day").text(at)
    return S.market_hours(spark, f"{at}/*/*.txt", "price").select(F.col("ts").cast("timestamp_ntz").alias("ts"), r("price", 5).alias("price"))


@query("feed_json_lines", "SRC09", "SNK07", sql="SELECT p_partkey, p_name, p_size FROM part")
def feed_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no objects, or broken, are left out."""
    at = folder(spark, "lines")
    K.append_jsonl(t(spark, d, "part").select("p_partkey", "p_name", "p_size"), at)
    spark.range(3).select(F.element_at(F.array(F.lit("[1, 2]"), F.lit('{"p_partkey": 1, '), F.lit("")), (F.col("id") + 1).cast("int")).alias("value")).write.mode("append").text(at)
    kinds = dict(t(spark, d, "part").dtypes)
    return S.jsonl(spark, at, f"p_partkey {kinds['p_partkey']}, p_name string, p_size {kinds['p_size']}", "p_partkey")


@query("feed_daily_values", "SRC22", "AGG19", sql=f"WITH {DAILY} SELECT day::DATE AS day, round(v, 5) AS value FROM daily WHERE event_type = 'purchase' AND day_of_month(day) <> 13".replace("day_of_month", "day"))
def feed_daily_values(spark: SparkSession, d: str) -> DataFrame:
    """A gauge's document of daily values; readings that are no numbers are dropped."""
    v = daily(spark, d).filter("event_type = 'purchase'")
    cell = F.when(F.dayofmonth("day") == 13, ".").otherwise(r("v", 5).cast("string"))
    values = F.array_sort(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd'T'00:00:00.000").alias("dateTime"), cell.alias("value"))))
    doc = F.struct(F.struct(F.array(F.struct(F.array(F.struct(values.alias("value"))).alias("values"))).alias("timeSeries")).alias("value"))
    return S.daily_values(spark, _one_text(v.agg(F.to_json(doc).alias("value")), folder(spark, "gauge"))).withColumn("value", r("value", 5))


# -- documents, lists, feeds -------------------------------------------------------------------------------------------------------


@query("feed_editions", "SRC10", "STR23", "STR24", sql="""
SELECT row_no, record_id, nullif(trim(title), '') AS title, coalesce(date_range.year_from, date_range.year_to) AS lo, coalesce(date_range.year_to, date_range.year_from) AS hi, nullif(trim(place), '') AS place,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(explicit_names, lambda x: trim(x)), lambda x: x <> ''))), ';') AS names, nullif(trim(sender), '') AS sender, nullif(trim(recipient), '') AS recipient
FROM papyri_documents WHERE record_id IS NOT NULL AND trim(record_id) <> ''""")  # fmt: skip
def feed_editions(spark: SparkSession, d: str) -> DataFrame:
    """Encoded editions made of the columns and parsed again: names by element, years by attribute, sender and recipient by role."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    p = t(spark, d, "papyri_documents").filter("record_id is not null and trim(record_id) <> ''")
    year = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"')), F.lit(""))
    role = lambda name, c: F.when(F.trim(c) != "", F.concat(F.lit(f'<persName role="{name}">'), esc(c), F.lit("</persName>"))).otherwise("")
    names = F.array_join(F.transform(F.coalesce("explicit_names", F.array().cast("array<string>")), lambda x: F.concat(F.lit("<persName>"), esc(x), F.lit("</persName>"))), "")
    xml = F.concat(
        F.lit('<TEI xmlns="urn:edition"><titleStmt><title>'), esc(F.col("title")), F.lit("</title></titleStmt><origDate"), year("notBefore", F.col("date_range.year_from")), year("notAfter", F.col("date_range.year_to")),
        F.lit("/><origPlace>"), esc(F.col("place")), F.lit("</origPlace><listPerson>"), names, F.lit("</listPerson><people>"), F.coalesce(role("letterSender", F.col("sender")), F.lit("")),
        F.coalesce(role("addressee", F.col("recipient")), F.lit("")), F.lit("</people></TEI>"),
    )
    src = p.select("row_no", "record_id", xml.alias("x"))
    got = S.edition_documents(src.select(F.concat(F.lit("https://editions.example/"), F.col("row_no").cast("string")).alias("u"), "x"), "u", "x")
    out = got.select(F.col("record_id").cast("bigint").alias("row_no"), "title", "date_range", "place", "explicit_names", "sender", "recipient")
    listed = F.array_except("explicit_names", F.array_compact(F.array("sender", "recipient")))
    again = src.select("row_no", "record_id", F.xpath("x", F.lit("//*[local-name()='listPerson']/*/text()")).alias("listed"))
    names_out = F.array_sort(F.array_distinct(F.filter(F.transform("listed", lambda n: F.trim(n)), lambda n: n != "")))
    return out.join(again, "row_no").withColumn("extra", F.size(listed)).select(
        "row_no", "record_id", "title", F.col("date_range.year_from").alias("lo"), F.col("date_range.year_to").alias("hi"), "place", F.array_join(names_out, ";").alias("names"), "sender", "recipient"
    )


@query("feed_tree", "SRC11", "SRC12", sql="SELECT r_name AS content, r_regionkey < 2 AS taken FROM region")
def feed_tree(spark: SparkSession, d: str) -> DataFrame:
    """All files below a folder, and the first two by path."""
    at = folder(spark, "tree")
    t(spark, d, "region").select("r_regionkey", F.col("r_name").alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(at)
    files = S.tree(spark, at, "*.txt")
    first = S.sampled(files, 2).select("path", F.lit(True).alias("t"))
    return files.join(first, "path", "left").select(F.trim(F.regexp_replace(F.decode("content", "UTF-8"), "\n", "")).alias("content"), F.coalesce("t", F.lit(False)).alias("taken"))


@query("feed_texts", "SRC13", sql="SELECT c_custkey::VARCHAR AS doc_id, c_name AS text FROM customer UNION ALL SELECT 'plain', string_agg(r_name, '|' ORDER BY r_name) FROM region")
def feed_texts(spark: SparkSession, d: str) -> DataFrame:
    """A CSV of texts and one plain file."""
    at = folder(spark, "texts")
    K.csv_parts(t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text")), f"{at}/a.csv")
    one = t(spark, d, "region").agg(F.array_join(F.array_sort(F.collect_list("r_name")), "|").alias("value"))
    plain = S.texts(spark, _one_text(one, f"{at}/plain")).select(F.lit("plain").alias("doc_id"), F.trim(F.regexp_replace("text", "\n", "")).alias("text"))
    return S.texts(spark, f"{at}/a.csv").unionByName(plain)


@query("feed_links", "SRC14", "STR20", "DQ09", "SET11", sql="""
SELECT k AS kind, 'https://x.example/' || n_nationkey AS url, n_name AS title, CASE WHEN n_regionkey > 1 THEN n_regionkey::VARCHAR END AS folder FROM nation CROSS JOIN (VALUES ('csv'), ('json'), ('txt')) v(k)
UNION ALL SELECT 'inline', 'https://x.example/inline', NULL, 'default'""")  # fmt: skip
def feed_links(spark: SparkSession, d: str) -> DataFrame:
    """Link lists in three formats by their suffix, and an inline row with a default folder; a list without its url column is refused."""
    at = folder(spark, "links")
    n = _nation(spark, d).select(F.concat(F.lit("https://x.example/"), "n_nationkey").alias("url"), F.col("n_name").alias("title"), F.lit(None).cast("string").alias("description"), F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")).alias("folder"))
    K.csv_parts(n, f"{at}/l.csv")
    _one_text(n.agg(F.to_json(F.collect_list(F.struct("url", "title", "folder"))).alias("value")), f"{at}/l.json")
    n.select(F.concat_ws("|", "url", "title", F.lit(" "), F.coalesce("folder", F.lit(""))).alias("value")).write.text(f"{at}/l.txt")
    K.csv_parts(n.select("title"), f"{at}/bad.csv")
    try:
        S.links(spark, f"{at}/bad.csv")
        raise AssertionError("a list without urls was read")
    except ValueError:
        pass
    out = None
    for kind in ("csv", "json", "txt"):
        one = S.links(spark, f"{at}/l.{kind}").select(F.lit(kind).alias("kind"), "url", "title", "folder")
        out = one if out is None else out.unionByName(one)
    inline = spark.createDataFrame([("inline", "https://x.example/inline", None, None)], "kind string, url string, title string, folder string")
    return out.unionByName(inline.withColumn("folder", F.coalesce("folder", F.lit("default"))))


@query("feed_ids", "SRC15", "SRC24", "FIL08", sql="SELECT DISTINCT game_id::VARCHAR AS id FROM season_pbp_2026 WHERE length(game_id::VARCHAR) = 9 AND game_id % 3 <> 0")
def feed_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a list (blank lines and other texts left out) that an earlier run has not fetched yet."""
    at = folder(spark, "ids")
    g = t(spark, d, "season_pbp_2026").select(F.col("game_id").cast("string").alias("value")).distinct()
    g.unionAll(spark.createDataFrame([("",), ("  ",), ("no id",)], "value string")).write.text(f"{at}/all")
    g.filter("cast(value as bigint) % 3 = 0").write.text(f"{at}/done")
    return S.pending(S.id_list(spark, f"{at}/all", r"^\d{9}$"), S.id_list(spark, f"{at}/done", r"^\d{9}$"), "id")


@query("feed_items", "SRC16", "FIL13", "DT16", sql="""
SELECT title, link, published FROM (SELECT 'run ' || run_no AS title, 'https://runs.example/' || run_no AS link, CASE WHEN run_no % 5 <> 0 THEN run_date::TIMESTAMP END AS published FROM metadata_analysis_v2)
WHERE published IS NULL OR published >= (SELECT max(run_date) FROM metadata_analysis_v2) - INTERVAL 400 DAY ORDER BY published DESC NULLS LAST, title LIMIT 8""")  # fmt: skip
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """A feed's items of the last 400 days, undated ones too, the newest eight."""
    m = t(spark, d, "metadata_analysis_v2").select("run_no", "run_date")
    when = F.when(F.col("run_no") % 5 != 0, F.date_format("run_date", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise("soon")
    item = F.concat(F.lit("<item><title>run "), F.col("run_no").cast("string"), F.lit("</title><link>https://runs.example/"), F.col("run_no").cast("string"), F.lit("</link><pubDate>"), when, F.lit("</pubDate></item>"))
    doc = m.agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("value"))  # a fixed list of twelve
    items = S.feed_items(spark, _one_text(doc, folder(spark, "feed")))
    last = m.agg(F.max("run_date")).first()[0]
    got = S.recent_items(items, times.mail_date(F.col("published")), F.lit(last).cast("timestamp"), 400, 8)
    return got.select("title", "link", times.mail_date(F.col("published")).cast("timestamp_ntz").alias("published"))


@query("feed_captions", "SRC17", sql="SELECT row_number() OVER (ORDER BY n_nationkey)::INTEGER AS k, n_name AS line FROM nation")
def feed_captions(spark: SparkSession, d: str) -> DataFrame:
    """A subtitle file in which every line stands twice in a row."""
    cue = F.concat(F.lit("\n\n"), F.col("n_nationkey").cast("string"), F.lit("\n00:00.000 --> 00:01.000\n<b>"), "n_name", F.lit("</b>\n"), "n_name")
    doc = _nation(spark, d).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cue.alias("c")))).alias("l"))
    at = _one_text(doc.select(F.concat(F.lit("WEBVTT"), F.array_join(F.transform("l", lambda x: x["c"]), "")).alias("value")), folder(spark, "vtt"))
    got = S.captions(spark, at).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return got.select(F.posexplode("l").alias("k", "x")).select((F.col("k") + 1).alias("k"), "x.line")


@query("feed_zip", "SRC18", sql="SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def feed_zip(spark: SparkSession, d: str) -> DataFrame:
    """A CSV in a ZIP archive, rows of one region."""
    at = _local(folder(spark, "zip"))
    body = io.StringIO()
    body.write("n_nationkey,n_name,n_regionkey\n")
    for x in _nation(spark, d).limit(10_000).collect():  # a fixed list
        body.write(f"{x['n_nationkey']},{x['n_name']},{x['n_regionkey']}\n")
    with zipfile.ZipFile(at / "n.zip", "w") as z:
        z.writestr("n.csv", body.getvalue())
    readers.register(spark)
    return spark.read.format("zip_csv").schema("n_nationkey string, n_name string").option("path", str(at)).option("where_n_regionkey", "1").load()


@query("feed_pages", "SRC19", sql="SELECT n_nationkey::BIGINT AS k, n_name FROM nation")
def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """A paged service read until its total is reached, a page a task."""
    at = _local(folder(spark, "pages"))
    rows = [x.asDict() for x in _nation(spark, d).select("n_nationkey", "n_name").limit(10_000).collect()]  # a fixed list
    for k in range(0, len(rows), 10):
        (at / f"{k}.json").write_text(json.dumps({"total": len(rows), "data": rows[k : k + 10]}))
    readers.register(spark)
    got = spark.read.format("paged_json").option("path", str(at)).option("page_size", "10").load()
    return got.select(F.from_json("value", "n_nationkey bigint, n_name string").alias("v")).select(F.col("v.n_nationkey").alias("k"), "v.n_name")


@query("feed_retries", "SRC20", sql="""
SELECT service, calls, waited::DOUBLE AS waited, ok FROM (VALUES ('ok', 1, 0.0, true), ('busy once', 2, 1.0, true), ('asked to wait', 2, 7.0, true), ('always busy', 4, 7.0, false), ('not found', 1, 0.0, false)) v(service, calls, waited, ok)""")  # fmt: skip
def feed_retries(spark: SparkSession, d: str) -> DataFrame:
    """How often and how long five services are tried: doubling waits, the wait a service asks for, no second try where none helps."""
    plan = {"ok": [(200, None)], "busy once": [(503, None), (200, None)], "asked to wait": [(429, 7.0), (200, None)], "always busy": [(500, None)] * 9, "not found": [(404, None)] * 9}
    out = []
    for name, answers in plan.items():
        calls, waits, it = [], [], iter(answers)

        def call(calls=calls, it=it):
            status, asked = next(it)
            calls.append(status)
            return status, "value", asked

        try:
            readers.Retry(jitter=0.0).run(call, waits.append)
            ok = True
        except RuntimeError:
            ok = False
        out.append((name, len(calls), float(sum(waits)), ok))
    return spark.createDataFrame(out, "service string, calls int, waited double, ok boolean")


@query("feed_isolated", "SRC21", sql="SELECT 'nations' AS source, count(*)::DOUBLE AS value, true AS ok FROM nation UNION ALL SELECT 'regions', count(*)::DOUBLE, true FROM region UNION ALL SELECT 'gone', NULL, false")
def feed_isolated(spark: SparkSession, d: str) -> DataFrame:
    """Several indicators of which one fails: its row says so, the others stand."""
    count = lambda name: lambda: t(spark, d, name).agg(F.count("*").cast("double").alias("value"))
    return readers.read_each(spark, {"nations": count("nation"), "regions": count("region"), "gone": count("no_such_table")}, "value double").select("source", "value", F.col("error").isNull().alias("ok"))


@query("feed_trend", "SRC23", sql="SELECT DATE '2024-01-01' + i::INTEGER AS day, round(1000 + 0.01 * i + 5 * sin(i * 2 * pi() / 365.25), 5) AS value FROM range(800) v(i)")
def feed_trend(spark: SparkSession, d: str) -> DataFrame:
    return S.trend_series(spark, 800, "2024-01-01", 1000.0, 0.01, 5.0, 0.0, 1).withColumn("value", r("value", 5))


@query("feed_result_links", "SRC25", sql="SELECT (n_nationkey * 2)::INTEGER AS pos, 'https://hits.example/' || n_nationkey AS url FROM nation")
def feed_result_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page on which each stands twice."""
    a = F.concat(F.lit('<a href="https://hits.example/'), F.col("n_nationkey").cast("string"), F.lit('">x</a>'))
    page = _nation(spark, d).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(a, a).alias("a")))), lambda x: x["a"]), " ").alias("html"))
    return S.result_links(page, "html", r'href="(https://hits\.example/\d+)"')


@query("feed_books", "SRC26", sql=r"""
SELECT doc_id, length(b)::INTEGER AS n, md5(b) AS digest FROM (SELECT doc_id, regexp_replace(text, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS b FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def feed_books(spark: SparkSession, d: str) -> DataFrame:
    """Texts in an envelope of start and end marks, taken out of it again."""
    text = F.concat(F.lit("Produced by hand\n*** START OF THE TEXT ***\n"), "text", F.lit("\n*** END OF THE TEXT ***\nLicence"))
    b = S.without_envelope(text)
    return t(spark, d, "documents").filter("text is not null").select("doc_id", b.alias("b")).select("doc_id", F.length("b").alias("n"), F.md5(F.encode("b", "UTF-8")).alias("digest"))


@query("feed_index", "SRC27", sql="""
SELECT tm_id, arg_max(place, row_no) AS place FROM papyri_documents WHERE tm_id IS NOT NULL AND place IS NOT NULL GROUP BY 1""")  # fmt: skip
def feed_index(spark: SparkSession, d: str) -> DataFrame:
    """The last place recorded for each number."""
    return S.metadata_index(t(spark, d, "papyri_documents").select("tm_id", "row_no", "place"), "tm_id", "row_no", ["place"])


# -- sinks -------------------------------------------------------------------------------------------------------------------------


@query("sink_nested", "SNK05", "JON16", sql="""
SELECT r_regionkey::INTEGER AS id, count(n_nationkey) AS n, coalesce(string_agg(n_name, ';' ORDER BY n_name), '') AS names FROM region LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON n_regionkey = r_regionkey GROUP BY 1""")  # fmt: skip
def sink_nested(spark: SparkSession, d: str) -> DataFrame:
    """Regions as JSON objects with the array of their nations (one has none), read back."""
    child = _nation(spark, d).filter("n_regionkey <> 3").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    doc = K.nested_export(t(spark, d, "region").select("r_regionkey", "r_name"), child, "r_regionkey", ["n_name"], ["n_name"], "nations")
    back = doc.select(F.col("id").cast("int").alias("id"), F.from_json("json", "nations array<struct<n_name: string>>")["nations"].alias("l"))
    return back.select("id", F.size("l").cast("bigint").alias("n"), F.array_join(F.transform("l", lambda x: x["n_name"]), ";").alias("names"))


@query("sink_two_tables", "SNK06", sql="""
SELECT 'parents' AS kind, r_regionkey::VARCHAR AS k, r_name || ' & co' AS v FROM region UNION ALL SELECT 'children', n_nationkey::VARCHAR, n_name FROM nation""")  # fmt: skip
def sink_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Parents and children as two CSV outputs side by side, markup taken out of the parents."""
    marked = t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.concat(F.lit("<b>"), "r_name", F.lit("</b> &amp; co")).alias("v"))
    one, two = K.two_tables(marked, _nation(spark, d).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), f"{folder(spark, 'two')}/out.csv", ["v"])
    read = lambda p, k: S.csv_text(spark, p).select(F.lit(k).alias("kind"), "k", "v")
    return read(one, "parents").unionByName(read(two, "children"))


@query("sink_manifest", "SNK08", "SNK09", "DQ06", sql="""
SELECT n_regionkey::BIGINT AS k, CASE WHEN n_regionkey < 2 THEN 'fresh' ELSE 'old' END AS status, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 9, 'fresh', 0""")  # fmt: skip
def sink_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A gzip-ed manifest whose rows of three units are replaced or added."""
    at = folder(spark, "manifest")
    m = _nation(spark, d).groupBy(F.col("n_regionkey").cast("bigint").alias("k")).agg(F.lit("old").alias("status"), F.count("*").alias("n"))
    K.gzip_json(m, at)
    fresh = m.filter("k < 2").withColumn("status", F.lit("fresh")).unionByName(spark.createDataFrame([(9, "fresh", 0)], "k bigint, status string, n bigint"))
    return K.upsert_manifest(spark, at, fresh, ["k"])


@query("sink_model", "SNK11", sql="SELECT count(*) AS n, 0.0::DOUBLE AS worst FROM lineitem")
def sink_model(spark: SparkSession, d: str) -> DataFrame:
    """A fitted model written and read again predicts the same."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    li = t(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("label"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["q", "x"], outputCol="features"), LinearRegression(maxIter=5)]).fit(li)
    at = folder(spark, "model")
    K.save_model(model, at)
    both = K.load_model(at).transform(model.transform(li).withColumnRenamed("prediction", "first").drop("features"))
    return both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("first") - F.col("prediction"))).alias("worst"))


@query("sink_report", "SNK12", "STR17", sql="""
SELECT 0 AS pos, '| team | points | share | odds |' AS line UNION ALL SELECT 1, '|-|-|-|-|' UNION ALL
SELECT (1 + row_number() OVER (ORDER BY team_id))::INTEGER, '| ' || coalesce(team_name, '') || ' | ' || coalesce(printf('%+.4f', avg_pts), '') || ' | ' || coalesce(printf('%.4f%%', 100 * pace_ratio), '') || ' | ' ||
  CASE WHEN games % 2 = 0 THEN '+150' ELSE '-110' END || ' |' FROM team_stats_2026 WHERE games IS NOT NULL""")  # fmt: skip
def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """The list of teams as lines of a report: signed numbers, percentages and odds."""
    s = t(spark, d, "team_stats_2026").filter("games is not null").select("team_id", F.col("team_name").alias("team"), F.col("avg_pts").alias("points"), (100 * F.col("pace_ratio")).alias("share"), F.when(F.col("games") % 2 == 0, 150).otherwise(-110).alias("odds"))
    return K.report_lines(s, "team_id", {"team": "%s", "points": "%+.4f", "share": "%.4f%%", "odds": "%+d"})


# -- text forms on real names ---------------------------------------------------------------------------------------------------------


@query("form_person_names", "STR02", sql=r"""
SELECT row_no, pos::INTEGER AS pos, regexp_replace(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(n, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g')),
  '^[ \t\n\x0B\f\r.,;:!?()\[\]{}"'']+|[ \t\n\x0B\f\r.,;:!?()\[\]{}"'']+$', '', 'g') AS name
FROM (SELECT row_no, unnest(person_names) AS n, generate_subscripts(person_names, 1) - 1 AS pos FROM papyri_documents) WHERE n IS NOT NULL""")  # fmt: skip
def form_person_names(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "papyri_documents").select("row_no", F.posexplode("person_names").alias("pos", "n")).filter("n is not null")
    return p.select("row_no", "pos", X.person_name(F.col("n")).alias("name"))


@query("form_old_spelling", "STR10", "STR12", "STR14", sql="""
SELECT doc_id, replace(replace(replace(replace(replace(replace(lower(trim(text)), 'ǣ', 'ae'), 'æ', 'ae'), 'œ', 'oe'), 'ꝛ', 'r'), 'ſ', 's'), 'u', 'v') = lower(trim(text)) AS modern,
  len(regexp_extract_all(lower(text), '[a-z'']+|[.!?]'))::INTEGER AS n_tokens FROM documents WHERE text IS NOT NULL""")  # fmt: skip
def form_old_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Texts that old orthography would leave as they are, and their tokens; a rejoined text has as many tokens."""
    x = t(spark, d, "documents").filter("text is not null")
    return x.select("doc_id", (X.old_spelling(F.col("text")) == F.lower(F.trim("text"))).alias("modern"), F.size(X.words(X.rejoin(X.words(F.col("text"))))).alias("n_tokens"))


@query("form_signs", "STR11", "STR21", sql="""
SELECT tm_nam_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce(tm_name, ''), '[₀₁₂₃₄₅₆₇₈₉]', '', 'g') || '-*301-12- A', '-'), lambda s: regexp_replace(trim(s), '^[*][0-9]+$', 'UNK')), lambda s: s <> '' AND NOT regexp_full_match(s, '[0-9]+')), '/') AS signs,
  'names/' || tm_nam_id || '_clean.csv' AS beside FROM tm_names""")  # fmt: skip
def form_signs(spark: SparkSession, d: str) -> DataFrame:
    """Names with a tail of signs taken apart, and the file beside another one."""
    n = t(spark, d, "tm_names")
    s = X.signs(F.concat(F.coalesce("tm_name", F.lit("")), F.lit("-*301-12- A")))
    path = F.concat(F.lit("names/"), F.col("tm_nam_id").cast("string"), F.lit(".csv"))
    return n.select("tm_nam_id", F.array_join(s, "/").alias("signs"), X.beside(path, "_clean").alias("beside"))
