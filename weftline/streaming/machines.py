"""Stateful streams: device cycles, first crossings, late labels, event-time windows; and their batch twins."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IDLE, RUNNING, FINISHING = "idle", "running", "finishing"


def step(state: str, began: float, low: float, t: float, watts: float, start: float, run: float, rest: float) -> tuple[str, float, float, tuple[float, float] | None]:
    """One reading of the cycle machine: (state, began, low since, finished cycle or None).  Times are seconds.

    Idle until ``start`` watts; running while at least ``run``; finishing below it; back to running if it rises again;
    idle, with a finished cycle, once it stayed below for ``rest`` seconds.  A cycle ends when it first went low.
    """
    if state == IDLE:
        return (RUNNING, t, low, None) if watts >= start else (IDLE, began, low, None)
    if state == RUNNING:
        return (RUNNING, began, low, None) if watts >= run else (FINISHING, began, t, None)
    if watts >= run:
        return RUNNING, began, low, None
    return (IDLE, began, low, (began, low)) if t - low >= rest else (FINISHING, began, low, None)


_OUT = "device string, began double, ended double"
_STATE = "state string, began double, low double"


def cycles_stream(readings: DataFrame, device: str, at: str, watts: str, start: float, run: float, rest: float) -> DataFrame:
    """Finished cycles of each device: state survives restarts in the stream's checkpoint."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, began, low = state.get if state.exists else (IDLE, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        out = []
        for t, w in zip(rows["t"], rows["w"]):
            s, began, low, done = step(s, began, low, t, w, start, run, rest)
            if done:
                out.append((key[0], *done))
        state.update((s, began, low))
        yield pd.DataFrame(out, columns=["device", "began", "ended"])

    src = readings.select(F.col(device).cast("string").alias("device"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(watts).cast("double").alias("w"))
    return src.groupBy("device").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def cycles_batch(readings: DataFrame, device: str, at: str, watts: str, start: float, run: float, rest: float) -> DataFrame:
    """The batch twin: the same machine over each device's readings in order of time."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, began, low = IDLE, 0.0, 0.0
        out = []
        rows = rows.sort_values(["t", "w"], kind="stable")
        for t, w in zip(rows["t"], rows["w"]):
            s, began, low, done = step(s, began, low, t, w, start, run, rest)
            if done:
                out.append((key[0], *done))
        return pd.DataFrame(out, columns=["device", "began", "ended"])

    src = readings.select(F.col(device).cast("string").alias("device"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(watts).cast("double").alias("w"))
    return src.groupBy("device").applyInPandas(fold, _OUT)


def active_spans(readings: DataFrame, device: str, at: str, watts: str, run: float) -> DataFrame:
    """Spans of consecutive readings at or above ``run`` (gaps and islands, JVM only): a coarse twin of the machine."""
    w = Window.partitionBy(device).orderBy(at)
    on = (F.col(watts) >= run).cast("int")
    marked = readings.withColumn("_on", on).withColumn("_n", F.sum(F.when(F.lag(on).over(w) == on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("_on = 1").groupBy(device, "_n").agg(F.min(at).alias("began"), F.max(at).alias("ended"), F.count("*").alias("n_readings")).drop("_n")


def tumbling(events: DataFrame, at: str, size: str, by: Sequence[str], *aggs: Column, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Aggregates per event-time window; with ``late`` a watermark bounds the state.  Works on streams and tables alike."""
    src = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        src = src.withWatermark(at, late)
    win = F.window(at, size, slide) if slide else F.window(at, size)
    return src.groupBy(win.alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("window_start"), *by, *[c for c in _names(aggs)])


def sessions(events: DataFrame, at: str, gap: str, by: Sequence[str], *aggs: Column, late: str | None = None) -> DataFrame:
    src = events.withColumn(at, F.col(at).cast("timestamp"))
    if late:
        src = src.withWatermark(at, late)
    return src.groupBy(F.session_window(at, gap).alias("w"), *by).agg(*aggs).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *_names(aggs))


def _names(aggs: Sequence[Column]) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggs]


def crossing_stream(events: DataFrame, game: str, side: str, points: str, at: str, target: float) -> DataFrame:
    """The side that first reaches ``target`` points in each game, emitted as soon as it does."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums, won = state.get if state.exists else ("{}", "")


        total = json.loads(sums)
        out = []
        for s, p in pd.concat(list(batches)).sort_values("t", kind="stable")[["s", "p"]].itertuples(index=False):
            total[s] = total.get(s, 0.0) + p
            if not won and total[s] >= target:
                won = s
                out.append((key[0], s))
        state.update((json.dumps(total), won))
        yield pd.DataFrame(out, columns=["game", "winner"])

    src = events.select(F.col(game).cast("string").alias("game"), F.col(side).alias("s"), F.col(points).cast("double").alias("p"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return src.groupBy("game").applyInPandasWithState(fold, "game string, winner string", "sums string, won string", "append", GroupStateTimeout.NoTimeout)


def label_late(events: DataFrame, event_day: Column, seen_day: Column) -> DataFrame:
    """Late rows get a label and stay in the stream; nothing is merged silently or dropped."""
    return events.withColumn("is_late", F.coalesce(seen_day > event_day, F.lit(False)))


def drain(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is (``availableNow``), write it to Parquet and read that: for batch use of streams."""
    spark: SparkSession = stream.sparkSession
    out, ckpt = f"{folder}/{name}/data", f"{folder}/{name}/checkpoint"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).format("parquet").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def poll(stream: DataFrame, seconds: int, each) -> object:
    """A stream polled at a fixed interval; ``each(df, batch)`` runs for every micro-batch."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(each).start()
