"""Simulations from hashes: every draw is a pure function of (seed, run, draw), so results repeat on any cluster."""

from __future__ import annotations

import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import IO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) out of the given columns."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def win_probability(a: Column, b: Column, sigma: float) -> Column:
    return 1 / (1 + F.exp(-(a - b) / F.lit(sigma) * 1.7))


def knockout_exact(seeds: DataFrame, slot: str, rating: str, rounds: int, sigma: float) -> DataFrame:
    """Exact chance of every entrant to survive each round of a knock-out of ``2 ** rounds`` slots (0-based).

    P(win round r) = P(win round r-1) * sum over the opponents' half of P(they get there) * P(beat them): one join a round.
    """
    cur = seeds.select(F.col(slot).alias("slot"), F.col(rating).alias("rating"), F.lit(1.0).alias("p"))
    out = None
    for r in range(1, rounds + 1):
        half = F.floor(F.col("slot") / (1 << (r - 1)))
        mine = cur.withColumn("grp", F.floor(F.col("slot") / (1 << r))).withColumn("half", half)
        other = mine.select(F.col("grp"), F.col("half").alias("oh"), F.col("rating").alias("orat"), F.col("p").alias("op"))
        cur = (
            mine.join(other, "grp").filter("half <> oh").groupBy("slot", "rating", "p")
            .agg(F.sum(F.col("op") * win_probability(F.col("rating"), F.col("orat"), sigma)).alias("s"))
            .select("slot", "rating", (F.col("p") * F.col("s")).alias("p"))
        )
        now = cur.select("slot", F.lit(r).alias("round"), "p")
        out = now if out is None else out.unionAll(now)
    return out


def knockout_runs(spark: SparkSession, ratings: Sequence[float], runs: int, sigma: float, seed: int) -> DataFrame:
    """``(run, round, slot)`` of the survivors of simulated knock-outs; vectorised over runs in Arrow batches."""
    r0 = np.asarray(ratings, dtype=float)

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            alive = np.tile(np.arange(len(r0)), (len(ids), 1))
            rng_base = np.uint64(seed)
            rnd = 0
            while alive.shape[1] > 1:
                rnd += 1
                a, c = alive[:, 0::2], alive[:, 1::2]
                p = 1 / (1 + np.exp(-(r0[a] - r0[c]) / sigma * 1.7))
                with np.errstate(over="ignore"):
                    x = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(a.shape[1], dtype=np.uint64) + np.uint64(rnd * 4096) + rng_base * np.uint64(0xD1B54A32D192ED03))
                    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
                        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
                u = (x >> np.uint64(12)).astype(float) / float(1 << 52)
                alive = np.where(u < p, a, c)
                yield pd.DataFrame({"run": np.repeat(ids, alive.shape[1]), "round": np.int32(rnd), "slot": alive.ravel()})

    return spark.range(runs).mapInPandas(play, "run bigint, round int, slot bigint")


def bankroll(spark: SparkSession, bets: Sequence[tuple[float, float]], fractions: Sequence[float], *, sims: int, cycles: int, start: float, ruin: float, seed: int) -> DataFrame:
    """Final bankrolls of repeated betting: ``(strategy, sim, final, ruined)``.  ``bets`` are (probability, decimal odds);
    a strategy stakes ``fraction`` of the growth-optimal share.  A ruined run stops."""
    plan = [(p, o, max(0.0, ((o - 1) * p - (1 - p)) / (o - 1))) for p, o in bets]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, f in enumerate(fractions):
                rng = [np.random.Generator(np.random.Philox(key=[seed, int(i) * 1000 + k])) for i in b["id"]]
                roll = np.full(len(b), start)
                gone = np.zeros(len(b), dtype=bool)
                draws = np.stack([g.random(cycles * len(plan)) for g in rng]) if len(b) else np.empty((0, 0))
                for c in range(cycles):
                    for j, (p, o, kelly) in enumerate(plan):
                        stake = np.where(gone, 0.0, roll * kelly * f)
                        roll = roll + np.where(draws[:, c * len(plan) + j] < p, stake * (o - 1), -stake)
                        gone |= roll < ruin
                yield pd.DataFrame({"strategy": np.int32(k), "sim": b["id"], "final": roll, "ruined": gone})

    return spark.range(sims).mapInPandas(run, "strategy int, sim bigint, final double, ruined boolean")


#: transitions in a packed block, at least: a block ends where a context ends
BLOCK_ROWS = 2_048


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(first, contexts, block)``: sorted transitions in compressed blocks, each of whole contexts."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    waiting: list[pa.Table] = []

    def packed(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK_ROWS)))
            end = int(starts[j]) if j < len(starts) else rows.num_rows
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as w:
                w.write_table(rows.slice(int(starts[i]), end - int(starts[i])).combine_chunks())
            out.append((rows["c"][int(starts[i])].as_py(), min(j, len(starts)) - i, sink.getvalue().to_pybytes()))
            i = j
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary()))], ["first", "contexts", "block"])

    for b in batches:
        b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
        if not b.num_rows:
            continue
        if waiting and b.column(0)[b.num_rows - 1] == waiting[0]["c"][0]:  # still the same context
            waiting.append(pa.Table.from_batches([b]))
            continue
        rows = pa.concat_tables([*waiting, pa.Table.from_batches([b])]).combine_chunks()
        starts = _starts(rows["c"])
        if len(starts) > 1 and starts[-1] > 0:
            yield packed(rows.slice(0, int(starts[-1])), starts[:-1])
        waiting = [rows.slice(int(starts[-1]))]
    if waiting:
        rows = pa.concat_tables(waiting)
        yield packed(rows, _starts(rows["c"]))


def _starts(contexts: pa.ChunkedArray) -> np.ndarray:
    """Where another context begins in sorted ones."""
    return np.r_[0, 1 + np.flatnonzero(pc.not_equal(contexts.slice(1), contexts.slice(0, len(contexts) - 1)).to_numpy())]


class _Transitions:
    """Packed blocks in a file of the task's own; what is in memory are the first context of each and the blocks read last."""

    def __init__(self, file: IO[bytes], batches: Iterator[pa.RecordBatch]) -> None:
        self.file, index = file, []
        for b in batches:
            for first, n, block in zip(*[b.column(i) for i in range(3)]):
                if first.is_valid:
                    index.append((first.as_py(), n.as_py(), file.tell(), file.write(block.as_buffer())))
        index.sort()
        self.first = [x[0] for x in index]
        self.before = np.concatenate([[0], np.cumsum([x[1] for x in index], dtype=np.int64)])
        self.at = [x[2:] for x in index]
        self.block = lru_cache(maxsize=256)(self._block)

    def _block(self, i: int) -> tuple[list[str], np.ndarray, pa.ChunkedArray, np.ndarray]:
        self.file.seek(self.at[i][0])
        rows = pa.ipc.open_stream(self.file.read(self.at[i][1])).read_all()
        starts = _starts(rows["c"])
        return rows["c"].take(pa.array(starts)).to_pylist(), np.r_[starts, rows.num_rows], rows["t"], rows["n"].to_numpy()

    def __len__(self) -> int:
        return int(self.before[-1])

    def context(self, k: int) -> str:
        """The ``k``-th context in order."""
        i = int(np.searchsorted(self.before, k, side="right")) - 1
        return self.block(i)[0][k - int(self.before[i])]

    def following(self, context: str) -> tuple[pa.ChunkedArray, np.ndarray] | None:
        """The tokens that follow, in order, and the shares up to each."""
        i = bisect_right(self.first, context) - 1
        if i < 0:
            return None
        contexts, starts, tokens, n = self.block(i)
        k = bisect_left(contexts, context)
        if k == len(contexts) or contexts[k] != context:
            return None
        a, b = int(starts[k]), int(starts[k + 1])
        return tokens.slice(a, b - a), np.cumsum(n[a:b]) / np.sum(n[a:b])


def markov_text(model: DataFrame, context: str, token: str, count: str, starts: Sequence[str], length: int, runs: int, seed: int, order: int = 1) -> DataFrame:
    """``(run, tokens array)``: weighted walks through a model ``(context, token, count)``, whose contexts are ``order`` tokens
    with blanks between; a dead end jumps to a random context, whose tokens are written down.

    The transitions are sorted and packed by all tasks; one task puts the compressed blocks into a file and walks through
    them, so that neither the driver nor any task holds the model, whatever its size."""
    rows = model.select(F.col(context).cast("string").alias("c"), F.col(token).cast("string").alias("t"), F.col(count).cast("bigint").alias("n"))
    blocks = rows.repartitionByRange("c").sortWithinPartitions("c", "t").mapInArrow(_pack, "first string, contexts bigint, block binary")
    none = model.sparkSession.range(1).select(F.lit(None).cast("string").alias("first"), F.lit(0).cast("bigint").alias("contexts"), F.lit(None).cast("binary").alias("block"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            tab = _Transitions(file, batches)
            out = []
            for i in range(runs):
                g = np.random.Generator(np.random.Philox(key=[seed, i]))
                seq = (starts[i % len(starts)] if starts else tab.context(int(g.integers(len(tab)))) if len(tab) else "").split(" ")
                while len(seq) < length and len(tab):
                    at = tab.following(" ".join(seq[-order:]))
                    if at is None:
                        seq += tab.context(int(g.integers(len(tab)))).split(" ")
                    else:
                        ts, cum = at
                        seq.append(ts[min(int(np.searchsorted(cum, g.random())), len(ts) - 1)].as_py())
                out.append(seq[:length])
            yield pa.RecordBatch.from_arrays([pa.array(range(runs), pa.int64()), pa.array(out, pa.list_(pa.string()))], ["run", "tokens"])

    return blocks.unionByName(none).repartition(1).mapInArrow(walk, "run bigint, tokens array<string>")


def holdout(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """A repeatable split by hash: ``part`` is 'test' for about ``share`` of the rows.  No ordering, no shuffle."""
    return df.withColumn("part", F.when(uniform(seed, F.col(key)) < share, "test").otherwise("train"))
