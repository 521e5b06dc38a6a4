"""Files to DataFrames.  Schemas are explicit or all-text; nothing is inferred by reading the data twice."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import piped, strip_markup
from weftline.operators.relational import keep_last


def csv_table(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema; cells that don't fit are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def csv_dated(spark: SparkSession, path: str, date: str, values: dict[str, str]) -> DataFrame:
    """CSV of a dated series: the date column as dates, the others cast, unreadable cells null."""
    raw = csv_text(spark, path)
    return raw.select(F.col(date).try_cast("date").alias(date), *[F.col(c).try_cast(t).alias(c) for c, t in values.items()])


def csv_text(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with every cell as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def json_map(spark: SparkSession, path: str, value_schema: str, key: str = "id") -> DataFrame:
    """A JSON object of objects (one document): a row per entry."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias(key, "value")).select(key, "value.*")


def json_series(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """(Gzip-ed) JSON files of parallel hourly arrays, laid end to end in order of their names: ``file, pos, time, variables...``."""
    fields = ", ".join(f"{v}: array<double>" for v in variables)
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    doc = raw.select("file", F.from_json("value", f"struct<hourly: struct<time: array<string>, {fields}>>").alias("d"))
    rows = F.arrays_zip(F.col("d.hourly.time"), *[F.col(f"d.hourly.{v}") for v in variables])
    out = doc.select("file", F.posexplode(rows).alias("pos", "r"))
    return out.select("file", "pos", F.col("r")["time"].alias("time"), *[F.col("r")[v].alias(v) for v in variables])


def if_present(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    """``read(spark, path)`` if anything lies there, else an empty table of ``schema``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return read(spark, path) if fs.globStatus(p) else spark.createDataFrame([], schema)


def market_hours(spark: SparkSession, path: str, value: str) -> DataFrame:
    """JSON files ``{"rows": [{"start_gmt": ..., value: ...}]}``: one value per UTC hour, the last file's last row wins."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    rows = raw.select("file", F.posexplode(F.from_json("value", f"struct<rows: array<struct<start_gmt: string, {value}: string>>>")["rows"]).alias("pos", "r"))
    hours = rows.select("file", "pos", F.date_trunc("hour", F.try_to_timestamp(F.concat(F.substring(F.col("r.start_gmt"), 1, 13), F.lit(":00")))).alias("ts"), F.col(f"r.{value}").try_cast("double").alias(value))
    return keep_last(hours.filter("ts is not null"), ["ts"], ["file", "pos"]).select("ts", value)


def jsonl(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """JSON lines; malformed lines and lines that are no objects are left out; in order of a column."""
    lines = spark.read.text(path).filter(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", f"struct<{schema}>", {"mode": "PERMISSIVE"}).alias("d"), F.try_parse_json("value").alias("v"))
    return parsed.filter("v is not null").select("d.*").orderBy(order)


def daily_values(spark: SparkSession, path: str) -> DataFrame:
    """A gauge's document ``{"value": {"timeSeries": [{"values": [{"value": [{"dateTime", "value"}]}]}]}}``: ``(day, value)`` of
    its first series; readings that are no numbers are left out."""
    shape = "struct<value: struct<timeSeries: array<struct<values: array<struct<value: array<struct<dateTime: string, value: string>>>>>>>>"
    first = lambda c: F.get(c, F.lit(0))
    doc = F.from_json("value", shape)["value"]["timeSeries"]
    rows = spark.read.text(path, wholetext=True).select(F.inline(first(first(doc)["values"])["value"]))
    return rows.select(F.substring("dateTime", 1, 10).try_cast("date").alias("day"), F.col("value").try_cast("double").alias("value")).filter("day is not null and value is not null")


def pending(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids of a list that are not among those already fetched, each once."""
    return ids.select(key).distinct().join(done.select(key), key, "left_anti")


def _at(path: str) -> str:
    """An XPath of plain names, blind to namespaces."""
    steps = []
    for s in path.split("/"):
        if s.startswith("@") or s in ("text()", ""):
            steps.append(s)
        else:
            name, _, cond = s.partition("[")
            steps.append(f"*[local-name()='{name}']" + (f"[{cond}" if cond else ""))
    return "//" + "/".join(steps)


def first_of(xml: Column, paths: Sequence[str]) -> Column:
    """The first path that has a non-blank text."""
    return F.coalesce(*[F.nullif(F.trim(F.xpath_string(xml, F.lit(_at(p)))), F.lit("")) for p in paths])


def edition_documents(df: DataFrame, url: str, xml: str) -> DataFrame:
    """Parsed documents of encoded editions (elements are found whatever their namespace)."""
    x = F.col(xml)
    year = lambda a: F.nullif(F.xpath_string(x, F.lit(f"//*[local-name()='origDate']/@{a}")), F.lit("")).try_cast("int")
    lo, hi = F.coalesce(year("notBefore"), year("when"), year("notAfter")), F.coalesce(year("notAfter"), year("when"), year("notBefore"))
    role = lambda words: F.filter(
        F.arrays_zip(F.xpath(x, F.lit("//*[local-name()='persName' and @role]/@role")).alias("role"), F.xpath(x, F.lit("//*[local-name()='persName' and @role]/text()")).alias("name")),
        lambda p: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(p["role"]).contains(w)),
    )
    first_name = lambda words: F.nullif(F.trim(F.get(role(words), F.lit(0))["name"]), F.lit(""))
    return df.select(
        F.col(url).alias("source_url"),
        F.coalesce(F.nullif(F.xpath_string(x, F.lit("/*/@*[local-name()='id']")), F.lit("")), F.regexp_extract(F.regexp_replace(F.col(url), "/+$", ""), r"([^/]+)$", 1)).alias("record_id"),
        first_of(x, ["titleStmt/title"]).alias("title"),
        F.nullif(F.trim(F.xpath_string(x, F.lit("//*[local-name()='idno'][@type='TM']"))), F.lit("")).alias("tm_id"),
        F.when(lo.isNotNull(), F.struct(lo.alias("year_from"), hi.alias("year_to"))).alias("date_range"),
        first_of(x, ["origPlace", "provenance/placeName", "placeName"]).alias("place"),
        F.array_distinct(F.filter(F.transform(F.xpath(x, F.lit("//*[local-name()='persName']/text()")), lambda n: F.trim(n)), lambda n: n != "")).alias("explicit_names"),
        first_name(["sender", "author", "from"]).alias("sender"),
        first_name(["recipient", "addressee"]).alias("recipient"),
        strip_markup(F.array_join(F.xpath(x, F.lit("//*[local-name()='div'][@type='edition']//text()")), " ")).alias("text"),
    )


def tree(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """All files below a folder that fit a glob: ``path, length, modificationTime, content`` (the content is read only if used)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def sampled(files: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """The first ``n`` files by path, or by a seeded hash of it."""
    return files.orderBy(F.xxhash64(F.lit(seed), "path") if seed is not None else F.col("path"), "path").limit(n)


def texts(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of a CSV with those columns, or of a plain text file as one document."""
    if path.lower().endswith(".csv"):
        return csv_text(spark, path).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("doc_id"), F.col("value").alias("text"))


def links(spark: SparkSession, path: str) -> DataFrame:
    """``(url, title, description, folder)`` of a CSV, JSON (list or ``{"items": [...]}``) or piped text file, by its suffix."""
    names = ("url", "title", "description", "folder")
    kind = PurePosixPath(path).suffix.lower()
    if kind == ".csv":
        raw = csv_text(spark, path)
        if "url" not in raw.columns:
            raise ValueError("the file has no column url")
        out = raw.select(*[(F.col(n) if n in raw.columns else F.lit(None).cast("string")).alias(n) for n in names])
    elif kind == ".json":
        item = "struct<" + ", ".join(f"{n}: string" for n in names) + ">"
        text = spark.read.text(path, wholetext=True)
        listed = F.regexp_replace("value", r"^\s+", "").startswith("[")
        both = F.when(listed, F.from_json("value", f"array<{item}>")).otherwise(F.from_json("value", f"struct<items: array<{item}>>")["items"])
        out = text.select(F.inline(F.filter(both, lambda x: x.isNotNull())))
    elif kind == ".txt":
        lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
        out = lines.select(piped(F.col("value")).alias("r")).select("r.*")
    else:
        raise ValueError(f"files of type {kind or 'none'} are not supported")
    out = out.select(*[F.nullif(F.trim(n), F.lit("")).alias(n) for n in names])
    bad = F.raise_error(F.lit("a link has no url")).cast("string")
    return out.withColumn("url", F.when(F.col("url").isNull(), bad).otherwise(F.col("url")))


def id_list(spark: SparkSession, path: str, pattern: str = r"^\S+$") -> DataFrame:
    """One id per line; blank lines, and lines that are no ids, are left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter(F.col("id").rlike(pattern))


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """``(title, link, published)`` of a feed's items."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<item\b.*?</item>)"), F.lit(1))).alias("i"))
    pick = lambda t: F.nullif(F.trim(F.xpath_string("i", F.lit(f"/item/*[local-name()='{t}']"))), F.lit(""))
    return rows.select(pick("title").alias("title"), pick("link").alias("link"), pick("pubDate").alias("published"))


def recent_items(items: DataFrame, published: Column, now: Column, days: int, limit: int) -> DataFrame:
    """Items of the last ``days``, undated ones too, at most ``limit`` of them, newest first."""
    ts = published
    return items.withColumn("_ts", ts).filter(F.coalesce(F.col("_ts") >= now - F.expr(f"interval {days} days"), F.lit(True))).orderBy(F.col("_ts").desc_nulls_last(), "title").limit(limit).drop("_ts")


def captions(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, line)`` of a subtitle file: header, cue numbers, times and blank lines out, tags stripped, repeats in a row once."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", r"<[^>]*>", ""))
    kept = text.withColumn("line", line).filter((F.col("line") != "") & ~F.col("line").rlike(r"^(WEBVTT|NOTE|Kind:|Language:)|-->|^\d+$"))
    one = kept.agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))  # the lines of one file
    fresh = F.filter("l", lambda x, i: (i == 0) | (x["line"] != F.get("l", i - 1)["line"]))
    return one.select(F.inline(fresh))


def result_links(df: DataFrame, html: str, pattern: str) -> DataFrame:
    """Addresses in result pages, each once, in order of first appearance: ``(pos, url)``."""
    got = df.select(F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "url"))
    return got.groupBy("url").agg(F.min("pos").alias("pos")).select("pos", "url")


def without_envelope(text: Column) -> Column:
    """A book's text between its START and END markers; whole if there are none."""
    body = F.regexp_replace(text, r"(?s)\A.*?\*\*\* ?START OF[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(body, r"(?s)\*\*\* ?END OF.*\z", ""), r"^\s+|\s+\z", "")


def metadata_index(df: DataFrame, key: str, order: str, take: Sequence[str]) -> DataFrame:
    """Last non-empty record per key: rows without any of ``take`` don't count."""
    full = df.filter(F.col(key).isNotNull() & F.coalesce(*[F.col(c).cast("string") for c in take]).isNotNull())
    return keep_last(full.select(key, order, *take), [key], [order]).select(key, *take)


def trend_series(spark: SparkSession, days: int, start: str, level: float, slope: float, swing: float, noise: float, seed: int) -> DataFrame:
    """A repeatable daily series: level, slope, yearly swing and hashed noise."""
    i = F.col("id")
    u = (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    value = F.lit(level) + F.lit(slope) * i + F.lit(swing) * F.sin(i * F.lit(2 * 3.141592653589793 / 365.25)) + F.lit(noise) * (u - 0.5)
    return spark.range(days).select(F.date_add(F.lit(start).cast("date"), i.cast("int")).alias("day"), value.alias("value"))
