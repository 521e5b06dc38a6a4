import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.sinks import files as K
from weftline.sources import files as S
from weftline.sources import readers as R
from weftline.streaming import machines as M

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="test.doc.1"><teiHeader><fileDesc><titleStmt><title>Test Document</title></titleStmt>
<publicationStmt><idno type="TM">12345</idno></publicationStmt><sourceDesc><origDate notBefore="-200" notAfter="-150"/><origPlace>Oxyrhynchus</origPlace></sourceDesc></fileDesc></teiHeader>
<text><body><div type="edition"><ab>χαίρειν <persName role="sender">Ζήνων</persName> <persName role="addressee">Θέων</persName></ab></div></body></text></TEI>"""


def test_edition_documents(spark):
    bare = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text/></TEI>'
    when = TEI.replace('notBefore="-200" notAfter="-150"', 'when="100"')
    df = spark.createDataFrame([("https://x/a/1/", TEI), ("https://x/b/2/", bare), ("https://x/c", when)], "url string, xml string")
    r = {x["source_url"]: x for x in S.edition_documents(df, "url", "xml").collect()}
    a = r["https://x/a/1/"]
    assert (a["record_id"], a["title"], a["tm_id"], a["place"]) == ("test.doc.1", "Test Document", "12345", "Oxyrhynchus")
    assert tuple(a["date_range"]) == (-200, -150) and a["explicit_names"] == ["Ζήνων", "Θέων"] and (a["sender"], a["recipient"]) == ("Ζήνων", "Θέων")
    assert "χαίρειν" in a["text"]
    b = r["https://x/b/2/"]
    assert (b["record_id"], b["tm_id"], b["date_range"], b["place"]) == ("2", None, None, None)
    assert tuple(r["https://x/c"]["date_range"]) == (100, 100)


def test_json_sources(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"1": {"n": 3}, "2": {"n": null}}')
    assert sorted((r["id"], r["n"]) for r in S.json_map(spark, str(tmp_path / "g.json"), "struct<n: int>").collect()) == [("1", 3), ("2", None)]
    for m, v in (("2026-01", [1.0, None]), ("2026-02", [3.0])):
        with gzip.open(tmp_path / f"{m}.json.gz", "wt") as f:
            json.dump({"hourly": {"time": [f"{m}-01T0{i}:00" for i in range(len(v))], "t": v}}, f)
    got = S.json_series(spark, str(tmp_path / "2026-*.json.gz"), ["t"]).orderBy("file", "pos").collect()
    assert [r["t"] for r in got] == [1.0, None, 3.0]
    (tmp_path / "m1.json").write_text('{"rows": [{"start_gmt": "2026-01-05T07:00:00-00:00", "mw": "5"}, {"start_gmt": "2026-01-05T07:30", "mw": "6"}]}')
    (tmp_path / "m2.json").write_text('{"rows": [{"start_gmt": "2026-01-05T08", "mw": "x"}]}')
    assert sorted((r["ts"].hour, r["mw"]) for r in S.market_hours(spark, str(tmp_path / "m*.json"), "mw").collect()) == [(7, 6.0), (8, None)]
    assert S.if_present(spark, str(tmp_path / "none*.json"), None, "a int").count() == 0
    (tmp_path / "h.jsonl").write_text('{"ts": "b", "v": 1}\nbroken {\n[1]\n\n{"ts": "a", "v": null}\n{"ts": "c"')
    assert [(r["ts"], r["v"]) for r in S.jsonl(spark, str(tmp_path / "h.jsonl"), "ts string, v int", "ts").collect()] == [("a", None), ("b", 1)]


def test_links_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text("url,title\nhttp://a,A\nhttp://b,\n")
    (tmp_path / "b.json").write_text('{"items": [{"url": "http://c", "title": "C"}]}')
    (tmp_path / "c.json").write_text('[{"url": "http://d"}]')
    (tmp_path / "d.txt").write_text("# note\n\nhttp://e | E | | f\nhttp://g\n")
    read = lambda n: [tuple(r) for r in S.links(spark, str(tmp_path / n)).collect()]
    assert read("a.csv") == [("http://a", "A", None, None), ("http://b", None, None, None)]
    assert read("b.json") == [("http://c", "C", None, None)] and read("c.json") == [("http://d", None, None, None)]
    assert read("d.txt") == [("http://e", "E", None, "f"), ("http://g", None, None, None)]
    with pytest.raises(ValueError):
        S.links(spark, str(tmp_path / "x.xml"))
    (tmp_path / "bad.csv").write_text("link\nx\n")
    with pytest.raises(ValueError, match="url"):
        S.links(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "blank.txt").write_text(" | no url\n")
    with pytest.raises(Exception, match="no url"):
        S.links(spark, str(tmp_path / "blank.txt")).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("401000001\n\n 401000002 \nx y\n")
    assert [r["id"] for r in S.id_list(spark, str(tmp_path / "ids.txt"), r"^401\d{6}$").collect()] == ["401000001", "401000002"]
    (tmp_path / "s.vtt").write_text("WEBVTT\n\n1\n00:01 --> 00:02\n<c>Hi</c> there\n\n2\n00:02 --> 00:03\nHi there\nBye\n")
    assert [r["line"] for r in S.captions(spark, str(tmp_path / "s.vtt")).orderBy("pos").collect()] == ["Hi there", "Bye"]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>A</title><link>l1</link><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate></item><item><title>B</title></item><item><title>C</title><pubDate>Mon, 05 Jan 2015 10:00:00 +0000</pubDate></item></channel></rss>")
    from weftline.functions.times import mail_date

    items = S.feed_items(spark, str(tmp_path / "feed.xml"))
    now = F.lit("2026-01-10").cast("timestamp")
    assert [r["title"] for r in S.recent_items(items, mail_date(F.col("published")), now, 30, 5).collect()] == ["A", "B"]
    (tmp_path / "d.csv").write_text("doc_id,text\n1,hello\n")
    assert [tuple(r) for r in S.texts(spark, str(tmp_path / "d.csv")).collect()] == [("1", "hello")]
    book = "x\n*** START OF THE BOOK ***\nbody\n*** END OF THE BOOK ***\ny"
    df = spark.createDataFrame([(book,), ("plain",)], "t string").select(S.without_envelope(F.col("t")).alias("t"))
    assert [r["t"] for r in df.collect()] == ["body", "plain"]
    page = spark.createDataFrame([('<a href="/d/1">x</a><a href="/d/2"><a href="/d/1">',)], "h string")
    assert [r["url"] for r in S.result_links(page, "h", r'href="(/d/\d+)"').orderBy("pos").collect()] == ["/d/1", "/d/2"]
    sub = tmp_path / "deep" / "er"
    sub.mkdir(parents=True)
    for i in range(5):
        (sub / f"{i}.xml").write_text("<a/>")
    t = S.tree(spark, str(tmp_path / "deep"), "*.xml")
    assert t.count() == 5 and [r["path"][-5:] for r in S.sampled(t, 2).collect()] == ["0.xml", "1.xml"]
    assert S.sampled(t, 3, seed=1).count() == 3
    s = S.trend_series(spark, 400, "2020-01-01", 100.0, -0.1, 5.0, 1.0, 7)
    assert s.collect() == S.trend_series(spark, 400, "2020-01-01", 100.0, -0.1, 5.0, 1.0, 7).collect()
    (tmp_path / "e.csv").write_text("date,elevation\n2026-01-01,1067.5\nbad,x\n")
    assert [r["elevation"] for r in S.csv_dated(spark, str(tmp_path / "e.csv"), "date", {"elevation": "double"}).filter("date is not null").collect()] == [1067.5]
    idx = spark.createDataFrame([("t1", 1, None, None), ("t1", 2, "P", None), ("t1", 3, None, None), (None, 4, "Q", 1)], "k string, n int, place string, y int")
    assert [tuple(r) for r in S.metadata_index(idx, "k", "n", ["place", "y"]).collect()] == [("t1", "P", None)]


def test_python_sources(spark, tmp_path):
    R.register(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "INTERVAL,ITEM,MW\n1,A,5\n2,B,6\n")
        z.writestr("note.txt", "no")
    got = spark.read.format("zip_csv").schema("INTERVAL string, MW string").option("path", str(tmp_path)).option("where_item", "A").load()
    assert [tuple(r) for r in got.collect()] == [("1", "5")]
    pages = tmp_path / "pages"
    pages.mkdir()
    for off, data in ((0, [{"p": 1}, {"p": 2}]), (2, [{"p": 3}])):
        (pages / f"{off}.json").write_text(json.dumps({"total": 3, "data": data}))
    p = spark.read.format("paged_json").option("path", str(pages)).option("page_size", "2").load()
    assert sorted(json.loads(r["value"])["p"] for r in p.collect()) == [1, 2, 3]
    seen, waits = iter([(503, None, None), (429, None, 7.0), (200, "v", None)]), []
    assert R.Retry(jitter=0).run(lambda: next(seen), waits.append) == "v" and waits == [1.0, 7.0]
    with pytest.raises(RuntimeError):
        R.Retry().run(lambda: (404, None, None), waits.append)


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(1, "<p>A</p>", True), (2, None, False)], "id long, text string, starred boolean")
    h = spark.createDataFrame([(1, 10, "x", None), (1, 11, "y", "n")], "id long, hid long, t string, note string")
    out = {r["id"]: json.loads(r["json"]) for r in K.nested_export(b, h, "id", ["hid", "t", "note"], ["hid"]).collect()}
    assert [x["hid"] for x in out[1]["highlights"]] == [10, 11] and out[2]["highlights"] == [] and out[1]["highlights"][0]["note"] is None
    first, second = K.two_tables(b, h, str(tmp_path / "articles.csv"), ["text"])
    assert second.endswith("articles_highlights.csv")
    assert [(r["text"], r["starred"]) for r in spark.read.csv(first, header=True).orderBy("id").collect()] == [("A", "1"), (None, "0")]
    assert spark.read.csv(second, header=True).count() == 2
    K.append_jsonl(h, str(tmp_path / "log"))
    K.append_jsonl(h, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    fresh = spark.createDataFrame([(1, 99, "z", None)], h.schema)
    assert K.upsert_manifest(spark, str(tmp_path / "log"), fresh, ["id"]).count() == 1
    K.gzip_json(h, str(tmp_path / "gz"), ["id"])
    assert spark.read.json(str(tmp_path / "gz")).count() == 2
    K.json_document(b, str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])["id"] == 1
    assert K.display_text(spark.createDataFrame([(1.25, None)], "a double, b string"), {"a": "%.1f"}).first()["b"] == ""
    from weftline.operators.models import make_model, scores

    train = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "a double, y double")
    K.save_model(make_model("linear", ["a"], "y").fit(train), str(tmp_path / "m"))
    assert scores(K.load_model(str(tmp_path / "m")), train).filter("a = 3").first()["score"] == pytest.approx(6.0)


def test_cycle_machine():
    s, b, low = M.IDLE, 0.0, 0.0
    done = []
    for t, w in [(0, 5), (10, 200), (20, 80), (30, 10), (40, 90), (50, 5), (60, 5), (120, 5), (130, 300)]:
        s, b, low, d = M.step(s, b, low, float(t), float(w), 100, 50, 60)
        done += [d] if d else []
    assert done == [(10.0, 50.0)] and s == M.RUNNING


def test_stream_equals_batch(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(data)
    args = ("user_id", "ts", "value", 100.0, 30.0, 3600.0)
    a = sorted(map(tuple, M.drain(M.cycles_stream(stream, *args), str(tmp_path), "c").collect()))
    assert a == sorted(map(tuple, M.cycles_batch(src, *args).collect())) and a
    agg = M.tumbling(stream, "ts", "1 day", ["event_type"], F.count("*").alias("n"), late="1 hour")
    got = M.drain(agg, str(tmp_path), "w")
    want = M.tumbling(src, "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    assert got.join(want, ["window_start", "event_type", "n"], "left_anti").count() == 0 < got.count() < want.count()
