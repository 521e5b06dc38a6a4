"""Mixing sources to target shares of tokens with soft membership.

1. A softmax classifier, trained on a bounded sample of labelled texts, gives every text posteriors over the sources that
   have a target.  A text without a label has only those; a label is a membership of its own beside them.
2. One distributed aggregation sums tokens and posteriors of cells of alike texts (label, likeliest domain, its posterior
   in 32 steps).  On these sums, projected-gradient least squares fits a non-negative rate for the documents of each
   cell, such that the expected tokens of every domain meet its target share, counted by label and counted by posterior.
   Where the two can't both be met, the labels' totals are met exactly and the posteriors' as nearly as that allows.
3. Whole copies realise the rates by one systematic draw over all texts, sorted by label and length: a text of rate r
   gets floor(r) or ceil(r) copies.  Long texts are drawn first and the shorter ones make up for what those missed, so
   that a source meets its total to within a short text.

Defined results
---------------
* a text counts once, whatever the number of rows that hold it: its first row (by id) stands for it;
* null and empty texts and texts without tokens take no part; so do labels without a target;
* texts without a label are used at most once, by their posteriors;
* targets that are null or not positive, or without any text, get nothing; the others' shares are scaled to sum to 1;
* a cap that is null or under 1 counts as 1; fewer than two labels with texts: posteriors are uniform;
* an empty corpus or empty targets give empty results; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.tokens import DEFAULT_RANKS, count_and_fold, shipped
from weftline.session import cut_lineage

#: most labelled texts of a source that the classifier is fitted on, and the number of its hashed features
MAX_PER_SOURCE = 300
FEATURES = 4096
#: steps of a posterior within a cell; and the lengths in tokens that part the classes of the draw
STEPS = 32
LENGTHS = (2048, 512, 128)


def unit_rows(counts: np.ndarray) -> np.ndarray:
    """Log-scaled counts of folded token ids, each row of unit length."""
    v = np.log1p(counts)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-4, steps: int = 150, rate: float = 8.0) -> np.ndarray:
    """Weights (features + 1, classes) by accelerated gradient descent; classes weigh the same."""
    z = np.c_[x, np.ones(len(x), dtype=np.float32)].astype(np.float32)
    share = (1.0 / np.maximum(1, np.bincount(y, minlength=classes)))[y] / classes
    w = np.zeros((z.shape[1], classes), dtype=np.float32)
    prev = w
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - prev)
        s = z @ v
        s -= s.max(axis=1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        prev, w = w, v - rate * (z.T @ (p * share[:, None].astype(np.float32)) + l2 * v)
    return w


def fit_rates(by_label: np.ndarray, by_belief: np.ndarray, want: np.ndarray, start: np.ndarray, caps: np.ndarray, weight: float = 0.3, ridge: float = 0.03, steps: int = 4000) -> np.ndarray:
    """Rates ``0 <= r <= caps`` of cells that minimise, by projected gradient, the relative error of ``by_label.T @ r`` and,
    with ``weight``, of ``by_belief.T @ r`` against ``want``; ``ridge`` holds them near ``start``."""
    m = np.vstack([by_label.T / want[:, None], np.sqrt(weight) * by_belief.T / want[:, None]])
    goal = np.r_[np.ones(len(want)), np.full(len(want), np.sqrt(weight))]
    scale = np.maximum(np.sqrt((m * m).sum(axis=0)), 1e-12)  # columns of unit length: all rates move at one pace
    m = m / scale
    top, x0 = caps * scale, start * scale
    x, prev = x0, x0
    lip = np.linalg.norm(m, 2) ** 2 + ridge
    for k in range(steps):
        v = x + (k / (k + 3)) * (x - prev)
        prev, x = x, np.clip(v - (m.T @ (m @ v - goal) + ridge * (v - x0)) / lip, 0, top)
        if np.abs(x - prev).max() < 1e-12 * max(1.0, np.abs(x).max()):
            break
    return x / scale


def meet_exactly(rate: np.ndarray, tokens: np.ndarray, caps: np.ndarray, want: float) -> np.ndarray:
    """``rate`` scaled down, or drawn towards ``caps``, such that it yields ``want`` tokens, or all that the caps allow."""
    have, most = float(rate @ tokens), float(caps @ tokens)
    if have > want > 0:
        return rate * (want / have)
    return rate + (caps - rate) * min(1.0, (want - have) / (most - have)) if most > have and want > 0 else rate * (want > 0)


def _units(docs: DataFrame, key: str, text: str, label: str, domains: list[str], weights: np.ndarray | None, path: str) -> DataFrame:
    """``(id, label, digest, n_tokens, cell, p)`` of every distinct text with a token; its first row stands for it."""
    n = len(domains)
    number = {d: k for k, d in enumerate(domains)}
    path = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, labels = b.column(1).to_pylist(), b.column(2).to_pylist()
            for a in range(0, len(texts), 512):
                z = min(len(texts), a + 512)
                sizes, counts = count_and_fold(texts[a:z], path, FEATURES if weights is not None else 0)
                if weights is None:
                    post = np.full((z - a, n), 1.0 / n)
                else:
                    s = unit_rows(counts) @ weights[:-1] + weights[-1]
                    post = np.exp(s - s.max(axis=1, keepdims=True)).astype(np.float64)
                    post /= post.sum(axis=1, keepdims=True)
                top = post.argmax(axis=1)
                lab = np.array([number.get(x, n) for x in labels[a:z]])
                cell = (lab * n + top) * STEPS + np.minimum((post.max(axis=1) * STEPS).astype(int), STEPS - 1)
                off = np.arange(0, (z - a) * n + 1, n, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, z - a), b.column(2).slice(a, z - a), b.column(3).slice(a, z - a), pa.array(sizes), pa.array(cell.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(post.ravel()))], ["id", "label", "digest", "n_tokens", "cell", "p"])

    src = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), F.col(label).cast("string").alias("label")).filter(F.length("t") > 0)
    src = src.filter(F.col("label").isNull() | F.col("label").isin(domains)).withColumn("digest", F.xxhash64("t", F.length("t")))
    every = src.mapInArrow(run, "id bigint, label string, digest bigint, n_tokens bigint, cell int, p array<double>").filter("n_tokens > 0")
    first = every.groupBy("digest").agg(F.min_by(F.struct("id", "label", "n_tokens", "cell", "p"), "id").alias("m"))
    kind = sum((F.when(F.col("n_tokens") <= c, 1).otherwise(0) for c in LENGTHS), F.lit(0))
    units = first.select("m.*", "digest").withColumn("kind", kind)
    # sorted once: the systematic draw walks through the partitions in this order
    return cut_lineage(units.repartitionByRange("label", "kind", "cell", "n_tokens", "id").sortWithinPartitions("label", "kind", "cell", "n_tokens", "id"))


def _classifier(docs: DataFrame, text: str, label: str, domains: list[str], per_source: int, path: str) -> np.ndarray | None:
    """The softmax weights, fitted on at most ``per_source`` texts of each source (those of the smallest hash).

    A count over the labels alone sets a threshold of the hash that leaves about four times as many, so the texts are read
    once and hardly any of them is moved; tasks keep ``per_source`` rows a label before the shuffle.
    """
    labelled = docs.filter(F.col(label).isin(domains) & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(label).alias("d"))
    n = {r["d"]: r["n"] for r in labelled.groupBy("d").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    top = F.create_map(*[x for d, k in n.items() for x in (F.lit(d), F.lit(min(1.0, 4.0 * per_source / k)))])[F.col("d")]
    u = F.xxhash64("t")
    near = labelled.withColumn("h", u).filter((F.pmod(F.col("h"), F.lit(1 << 52)) / F.lit(float(1 << 52))) <= top)
    rank = F.row_number().over(Window.partitionBy("d").orderBy(F.pmod(F.col("h"), F.lit(1 << 52)), "t"))
    rows = near.withColumn("rn", rank).filter(F.col("rn") <= per_source).select("d", "t").collect()
    number = {d: k for k, d in enumerate(domains)}
    rows.sort(key=lambda r: (r["d"], r["t"]))
    y = np.array([number[r["d"]] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    x = np.vstack([unit_rows(count_and_fold([r["t"] for r in rows[a : a + 512]], path, FEATURES)[1]) for a in range(0, len(rows), 512)])
    return fit_softmax(x, y, len(domains))


def _draw(units: DataFrame, cells: int, rate: np.ndarray, caps: np.ndarray, domains: int, plan: dict | None):
    """A function over sorted partitions: without a ``plan`` it gives the sums that place the draw, with one the copies."""
    kinds = len(LENGTHS) + 1
    per_label = domains * STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        sums = np.zeros(((domains + 1) * kinds, 4))
        at = dict(plan["offset"].get(pid, {})) if plan else {}
        for b in batches:
            if not b.num_rows:
                continue
            w, cell, kind = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            r, c = rate[cell], caps[cell]
            group = (cell // per_label) * kinds + kind
            if plan is None:
                for j, v in enumerate((r, c - r, r * w, (c - r) * w)):
                    sums[:, j] += np.bincount(group, weights=v, minlength=len(sums))
                continue
            copies = np.zeros(len(w), dtype=np.int32)
            for g in np.unique(group):
                sel = np.flatnonzero(group == g)
                s, x = plan["adjust"][g]
                step = s * r[sel] + x * (c[sel] - r[sel])
                start = at.get(int(g), 0.5)
                walk = np.r_[start, start + np.cumsum(step)]
                copies[sel] = np.clip(np.diff(np.floor(walk)), 0, c[sel])
                at[int(g)] = walk[-1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group.astype(np.int32)), pa.array(cell), pa.array(r), pa.array(copies)], ["id", "n_tokens", "grp", "cell", "rate", "copies"])
        if plan is None:
            live = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(live), pid, dtype=np.int32)), pa.array(live.astype(np.int32)), *[pa.array(sums[live, j]) for j in range(4)]], ["pid", "grp", "a", "b", "aw", "bw"])

    src = units.select("id", "n_tokens", "cell", "kind")
    if plan is None:
        return src.mapInArrow(run, "pid int, grp int, a double, b double, aw double, bw double")
    return src.mapInArrow(run, "id bigint, n_tokens bigint, grp int, cell int, rate double, copies int")


def mix_sources(
    docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "source", target_label: str = "source",
    share: str = "target_share", cap: str = "max_repeats", per_source: int = MAX_PER_SOURCE, path: str = DEFAULT_RANKS, max_sources: int = 100, classify: bool = True,
) -> DataFrame:
    """``(key, label, n_tokens, rate, copies, posteriors)`` of every text that the mix uses.

    ``rate`` is the fitted non-negative rate, ``copies`` its whole realisation (at most the cap of the text's source; a text
    without a label is never repeated), ``posteriors`` those of the target sources in alphabetical order.
    """
    rows = targets.select(F.col(target_label).alias("d"), F.col(share).alias("s"), F.col(cap).alias("c")).filter("d is not null and s > 0").limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    caps_by = {r["d"]: float(max(1, r["c"] or 1)) for r in rows}
    share_by = {r["d"]: float(r["s"]) for r in rows}
    domains = sorted(share_by)
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(label, T.StringType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("rate", T.DoubleType()), T.StructField("copies", T.IntegerType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])
    nothing = docs.sparkSession.createDataFrame([], schema)
    if not domains:
        return nothing
    n, kinds = len(domains), len(LENGTHS) + 1
    weights = _classifier(docs, text, label, domains, per_source, path) if classify else None
    units = _units(docs, key, text, label, domains, weights, path)
    sums = units.groupBy("cell").agg(F.sum("n_tokens").alias("w"), *[F.sum(F.col("n_tokens") * F.get("p", F.lit(k))).alias(f"p{k}") for k in range(n)]).collect()
    if not sums:
        return nothing

    # the cells: at most (n + 1) * n * STEPS rows
    size = (n + 1) * n * STEPS
    w, belief = np.zeros(size), np.zeros((size, n))
    for r in sums:
        w[r["cell"]] = r["w"]
        belief[r["cell"]] = [r[f"p{k}"] for k in range(n)]
    of = np.arange(size) // (n * STEPS)
    own = belief.copy()
    own[of < n] = 0
    own[np.flatnonzero(of < n), of[of < n]] = w[of < n]
    caps = np.array([*[caps_by[d] for d in domains], 1.0])[of]
    most = caps @ own
    live = np.flatnonzero(np.array([w[of == k].sum() for k in range(n)]) > 0)
    if not len(live):
        return nothing
    t = np.array([share_by[domains[k]] for k in live])
    t = t / t.sum()
    total = float((most[live] / t).min())  # the largest mix in which every source can reach its share
    used, loose = np.flatnonzero(w > 0), of == n
    rate = np.zeros(size)
    for _ in range(50):
        want = np.zeros(n)
        want[live] = t * total
        start = np.minimum(np.r_[want / np.maximum(most, 1e-9), 0.0][of] * caps, caps)
        start[loose] = min(1.0, total / max(float(most.sum()), 1e-9))
        rate[used] = fit_rates(own[np.ix_(used, live)], belief[np.ix_(used, live)], want[live], start[used], caps[used])
        for k in range(n):
            mine = of == k
            rate[mine] = meet_exactly(rate[mine], w[mine], caps[mine], want[k] - float(rate[loose] @ own[loose, k]))
        reached = float(((rate @ own)[live] / want[live]).min())
        if reached > 1 - 1e-4:
            break
        total *= reached  # texts without a label belong to several domains: a smaller mix is the largest that meets all targets
    # the draw, long texts first: each class makes up for what the longer ones of its label missed
    place = _draw(units, size, rate, caps, n, None).collect()  # a row per partition and group
    total_of = np.zeros(((n + 1) * kinds, 4))
    for r in place:
        total_of[r["grp"]] += (r["a"], r["b"], r["aw"], r["bw"])
    adjust = {g: (1.0, 0.0) for g in range((n + 1) * kinds)}

    def plan() -> dict:
        offset: dict[int, dict[int, float]] = {}
        run = dict.fromkeys(range((n + 1) * kinds), 0.5)
        by = {(r["pid"], r["grp"]): r for r in place}
        for pid in sorted({r["pid"] for r in place}):
            offset[pid] = dict(run)
            for g in run:
                r = by.get((pid, g))
                if r:
                    run[g] += adjust[g][0] * r["a"] + adjust[g][1] * r["b"]
        return {"offset": offset, "adjust": adjust}

    missed = np.zeros(n)
    if w[loose].any():  # what the texts without a label bring is known before the others are drawn
        got = _draw(units.filter(F.col("label").isNull()), size, rate, caps, n, plan()).groupBy("cell").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
        for r in got:
            missed += (float(r["n"]) / w[r["cell"]] - rate[r["cell"]]) * own[r["cell"]]
    for kind in range(kinds):
        for k in range(n):
            _, _, aw, bw = total_of[k * kinds + kind]
            goal = min(max(aw - missed[k], 0.0), aw + bw)
            adjust[k * kinds + kind] = (goal / aw, 0.0) if aw > 0 and goal <= aw else (1.0, (goal - aw) / bw if bw > 0 else 0.0)
        if kind + 1 < kinds:
            got = _draw(units.filter(F.col("kind") == kind), size, rate, caps, n, plan()).groupBy("grp").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
            real = {r["grp"]: float(r["n"]) for r in got}
            missed += np.array([real.get(k * kinds + kind, 0.0) - total_of[k * kinds + kind][2] for k in range(n)])
    drawn = _draw(units, size, rate, caps, n, plan()).filter("copies > 0").select("id", F.round("rate", 9).alias("rate"), "copies")
    out = units.select("id", "label", "n_tokens", "p").join(drawn, "id")
    return out.select(F.col("id").alias(key), F.col("label").alias(label), "n_tokens", "rate", "copies", F.transform("p", lambda x: F.round(x, 4)).alias("posteriors"))


def mix_report(mix: DataFrame, targets: DataFrame, *, label: str = "source", share: str = "target_share", cap: str = "max_repeats") -> DataFrame:
    """Per target source what the mix reached: texts, tokens, most copies of one text, and the target share beside the
    actual share by label (texts without one by their posteriors) and by posterior."""
    names = [r[0] for r in targets.filter(F.col(label).isNotNull() & (F.col(share) > 0)).select(label).distinct().orderBy(label).limit(1001).collect()]
    size = F.col("n_tokens") * F.col("copies")
    soft = mix.select(label, size.alias("w"), "copies", F.posexplode("posteriors").alias("k", "q"))
    name = F.get(F.array(*[F.lit(x) for x in names]).cast("array<string>"), F.col("k"))
    used = soft.groupBy(name.alias(label)).agg(
        F.sum(F.when(F.col(label) == name, 1).otherwise(0)).alias("n_texts"),
        F.sum(F.when(F.col(label) == name, F.col("w")).when(F.col(label).isNull(), F.col("w") * F.col("q")).otherwise(0)).alias("tokens"),
        F.max(F.when(F.col(label) == name, F.col("copies"))).alias("most_copies"),
        F.sum(F.col("w") * F.col("q")).alias("belief"),
    )
    total = float(mix.agg(F.sum(size).alias("t")).first()["t"] or 1)
    z = lambda c: F.coalesce(c, F.lit(0))
    return targets.select(label, share, cap).join(used, label, "left").select(
        label, share, cap, z("n_texts").alias("n_texts"), z("tokens").alias("tokens"), z("most_copies").alias("most_copies"),
        (z("tokens") / total).alias("actual_share"), (z("belief") / total).alias("posterior_share"),
    )
