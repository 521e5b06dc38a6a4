"""Streams drained over what there is, beside their batch twins."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.plans._util import r, t
from weftline.session import ensure_checkpoint_dir
from weftline.streaming import machines as M


def _folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints: shared on a cluster, local in tests."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/streams-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    src = t(spark, d, "events")
    return spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("stream_tumbling", "EXT16", sql="""
SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")  # fmt: skip
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Daily windows of a stream in update mode; the last state of each window is its result."""
    agg = M.tumbling(_stream(spark, d), "ts", "1 day", ["event_type"], F.count("*").alias("n"), F.sum("value").alias("total"))
    folder, rows = _folder(spark), []

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("_batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/out")

    q = agg.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/ckpt").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    del rows
    out = spark.read.parquet(f"{folder}/out")
    last = out.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("s"))
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "s.n", r("s.total", 4).alias("total"))


@query("stream_sliding_twin", "EXT16", sql="""
WITH b AS (SELECT ts, value, unnest([0, 1]) AS k FROM events)
SELECT (time_bucket(INTERVAL 1 DAY, ts) - k * INTERVAL 1 DAY)::TIMESTAMP AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY 1""")  # fmt: skip
def stream_sliding_twin(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of a two-day window that slides by a day."""
    w = M.tumbling(t(spark, d, "events"), "ts", "2 days", [], F.count("*").alias("n"), F.sum("value").alias("total"), slide="1 day")
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", r("total", 4).alias("total"))


@query("stream_session_twin", "EXT16", sql="""
WITH k AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM k)
SELECT user_id, min(ts) AS session_start, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS session_end, count(*) AS n FROM s GROUP BY user_id, g""")  # fmt: skip
def stream_session_twin(spark: SparkSession, d: str) -> DataFrame:
    s = M.sessions(t(spark, d, "events"), "ts", "6 hours", ["user_id"], F.count("*").alias("n"))
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("stream_cycles", "STM01", "STM02")
def stream_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Finished cycles of every device from the stateful stream."""
    return M.drain(M.cycles_stream(_stream(spark, d), "user_id", "ts", "value", 100.0, 30.0, 3600.0), _folder(spark), "cycles")


@query("batch_cycles", "STM01")
def batch_cycles(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of the cycles."""
    return M.cycles_batch(t(spark, d, "events"), "user_id", "ts", "value", 100.0, 30.0, 3600.0)


@query("stream_first_to_ten", "STM03", sql="""
WITH k AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events)
SELECT user_id::VARCHAR AS game, arg_min(event_type, ts) AS winner FROM k WHERE n = 10 GROUP BY 1""")  # fmt: skip
def stream_first_to_ten(spark: SparkSession, d: str) -> DataFrame:
    """The kind of event that a user first has ten of, emitted as soon as it is known."""
    s = _stream(spark, d).withColumn("one", F.lit(1.0))
    return M.drain(M.crossing_stream(s, "user_id", "event_type", "one", "ts", 10.0), _folder(spark), "race")


@query("stream_static_join", "EXT17", "STM05", sql="""
SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 END AS kind, ts::DATE < DATE '2024-01-15' AS is_late FROM events""")  # fmt: skip
def stream_static_join(spark: SparkSession, d: str) -> DataFrame:
    """A stream joined to a small table (kinds that it lacks stay null), late rows labelled and kept."""
    kinds = spark.createDataFrame([("click", 1), ("view", 2), ("purchase", 3)], "event_type string, kind int")
    j = _stream(spark, d).join(F.broadcast(kinds), "event_type", "left").withColumn("ts", F.col("ts").cast("timestamp"))
    late = M.label_late(j, F.to_date("ts"), F.lit("2024-01-15").cast("date"))
    return M.drain(late.select("event_id", "kind", "is_late"), _folder(spark), "joined")


@query("stream_stream_join", "EXT17", sql="""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts""")  # fmt: skip
def stream_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases met with the clicks of the two hours before, both as streams; watermarks bound the state on either side."""
    side = lambda kind, i, at: (
        _stream(spark, d).filter(F.col("event_type") == kind).select(F.col("event_id").alias(i), F.col("user_id").alias(f"u{i}"), F.col("ts").cast("timestamp").alias(at)).withWatermark(at, "1 day")
    )
    j = side("purchase", "a", "at").join(side("click", "b", "bt"), F.expr("ua = ub AND bt <= at AND bt >= at - interval 2 hours"))
    return M.drain(j.select("a", "b"), _folder(spark), "both")


@query("stream_dedup", "EXT17", sql="SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row per event id within the watermark."""
    s = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return M.drain(s.select("event_id", "event_type"), _folder(spark), "dedup")
