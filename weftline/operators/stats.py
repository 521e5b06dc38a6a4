"""Statistics and information theory over grouped counts.

Everything starts from counts (``groupBy`` with map-side combine), whose number is bounded by the vocabulary and not by
the corpus; totals come from a second, tiny aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.sequences import global_rank
from weftline.session import cut_lineage


def counts(df: DataFrame, by: Sequence[str], token: str) -> DataFrame:
    return df.groupBy(*by, token).agg(F.count("*").alias("n"))


def entropy(cnt: DataFrame, by: Sequence[str]) -> DataFrame:
    """Shannon entropy in bits of each group's count distribution: log2 N - sum(n log2 n) / N, one aggregation."""
    out = cnt.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
    return out.select(*by, "total", (F.log2("total") - F.col("_s") / F.col("total")).alias("entropy"))


def conditional_entropy(pairs: DataFrame, by: Sequence[str], context: str, token: str) -> DataFrame:
    """H(token | context) in bits, weighted by the contexts' shares; ``pairs`` has one row per occurrence."""
    joint = pairs.groupBy(*by, context, token).agg(F.count("*").alias("n"))
    ctx = joint.groupBy(*by, context).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    out = ctx.groupBy(*by).agg(F.sum("m").alias("total"), F.sum(F.col("m") * F.log2("m") - F.col("s")).alias("_h"))
    return out.select(*by, (F.col("_h") / F.col("total")).alias("cond_entropy"))


def mean_context_entropy(pairs: DataFrame, by: Sequence[str], context: str, token: str) -> DataFrame:
    """The unweighted mean over contexts of the entropy of what follows."""
    joint = pairs.groupBy(*by, context, token).agg(F.count("*").alias("n"))
    ctx = joint.groupBy(*by, context).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return ctx.groupBy(*by).agg(F.avg(F.log2("m") - F.col("s") / F.col("m")).alias("mean_entropy"), F.count("*").alias("n_contexts"))


def zipf(cnt: DataFrame, token: str, top: int | None = None, least: int = 5) -> DataFrame:
    """Slope and R-squared of log frequency on log rank; 0 and 0 for fewer than ``least`` types."""
    ranked = global_rank(cnt, [F.col("n").desc(), F.col(token).asc()])
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("n").cast("double"))
    agg = ranked.agg(F.count("*").alias("types"), F.regr_slope(y, x).alias("s"), F.when(F.stddev_pop(y) > 0, F.regr_r2(y, x)).alias("r"))
    ok = F.col("types") >= least
    return agg.select("types", F.when(ok, F.col("s")).otherwise(0.0).alias("slope"), F.when(ok, F.coalesce("r", F.lit(1.0))).otherwise(0.0).alias("r2"))


def successors(pairs: DataFrame, context: str, token: str) -> DataFrame:
    """Profile per context: total, number of successors, dominant successor and its share, entropy of what follows."""
    joint = pairs.groupBy(context, token).agg(F.count("*").alias("n"))
    return (
        joint.groupBy(context)
        .agg(F.sum("n").alias("total_out"), F.count("*").alias("n_successors"), F.min_by(token, F.struct(-F.col("n"), F.col(token))).alias("dominant"),
             F.max("n").alias("_m"), F.sum(F.col("n") * F.log2("n")).alias("_s"))
        .select(context, "total_out", "n_successors", "dominant", (F.col("_m") / F.col("total_out")).alias("share"),
                F.greatest(F.lit(0.0), F.log2("total_out") - F.col("_s") / F.col("total_out")).alias("entropy_out"))
    )


def gini(cnt: DataFrame, value: str = "n") -> DataFrame:
    """Gini coefficient.  Equal values form one block, so ranks are never assigned row by row: the work follows the number
    of distinct values."""
    blocks = cnt.groupBy(value).agg(F.count("*").alias("k"))
    w = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)  # over distinct values only
    b = blocks.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    tot = blocks.agg(F.sum("k").alias("_all"), F.sum(F.col(value) * F.col("k")).alias("_sum"))
    rank_sum = F.col(value) * (F.col("k") * (2 * F.col("before") + F.col("k") + 1) - F.col("k") * (F.col("_all") + 1))
    return b.join(F.broadcast(tot)).agg((F.sum(rank_sum) / F.first(F.col("_all") * F.col("_sum"))).alias("gini"))


def richness(cnt: DataFrame, by: Sequence[str]) -> DataFrame:
    """Types, tokens, type-token ratio, and the share of types met once."""
    return cnt.groupBy(*by).agg(
        F.count("*").alias("types"), F.sum("n").alias("tokens"), (F.count("*") / F.sum("n")).alias("ttr"),
        (F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.count("*")).alias("hapax_ratio"),
    )


def positions(df: DataFrame, tokens: Column, least: int, weight: str | None = None) -> DataFrame:
    """Per token how often it stands first, inside and last in its row, shares, and the entropy of the three.  A row counts
    ``weight`` times, so equal rows may be counted beforehand."""
    t = df.select(F.posexplode(tokens).alias("pos", "token"), F.size(tokens).alias("len"), (F.col(weight) if weight else F.lit(1)).alias("w")).filter(F.col("len") > 1)
    first, last = F.col("pos") == 0, F.col("pos") == F.col("len") - 1
    one = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    g = t.groupBy("token").agg(F.sum("w").alias("n"), one(first).alias("n_first"), one(last).alias("n_last")).filter(F.col("n") >= least)
    g = g.withColumn("n_mid", F.col("n") - F.col("n_first") - F.col("n_last"))
    share = {c: F.col(f"n_{c}") / F.col("n") for c in ("first", "mid", "last")}
    h = sum((F.when(s > 0, -s * F.log2(s)).otherwise(F.lit(0.0)) for s in share.values()), F.lit(0.0))
    role = F.when(share["first"] >= 0.6, "initial").when(share["last"] >= 0.6, "final").when(share["mid"] >= 0.6, "medial").otherwise("free")
    return g.select("token", "n", *[s.alias(f"share_{c}") for c, s in share.items()], h.alias("entropy"), role.alias("role"))


def kmeans(df: DataFrame, key: str, dims: Sequence[str], centers: Sequence[Sequence[float]], iterations: int = 20) -> DataFrame:
    """Hard k-means from fixed centres: each round is one aggregation; the centres (k rows) travel as literals."""
    c = [list(map(float, x)) for x in centers]
    for _ in range(iterations):
        got = {r["cluster"]: r for r in _nearest(df, dims, c).groupBy("cluster").agg(*[F.avg(d).alias(d) for d in dims]).collect()}
        new = [[float(got[i][d]) for d in dims] if i in got else c[i] for i in range(len(c))]
        if new == c:
            break
        c = new
    return _nearest(df, dims, c).select(key, "cluster")


def _nearest(df: DataFrame, dims: Sequence[str], centers: list[list[float]]) -> DataFrame:
    dist = [sum(((F.col(d) - F.lit(v)) * (F.col(d) - F.lit(v)) for d, v in zip(dims, x)), F.lit(0.0)) for x in centers]
    best = F.least(*dist) if len(dist) > 1 else dist[0]
    out = F.lit(len(dist) - 1)
    for i in reversed(range(len(dist) - 1)):
        out = F.when(dist[i] == best, i).otherwise(out)
    return df.withColumn("cluster", out)


def chains(links: DataFrame) -> DataFrame:
    """Longest walks along single successors ``links(a, b)`` without coming back: ``start, path``.

    Starts are tokens that are nobody's successor, or any token of a pure ring; each round lengthens all walks by one.
    """
    nxt = cut_lineage(links.select("a", "b").dropDuplicates(["a"]))
    heads = nxt.join(nxt.select(F.col("b").alias("a")), "a", "left_anti")
    live = heads.select(F.col("a").alias("start"), F.array("a", "b").alias("path"), F.col("b").alias("tip"))
    done = None
    while True:
        step = live.join(nxt.withColumnRenamed("a", "tip"), "tip", "left").withColumn("_go", F.col("b").isNotNull() & ~F.array_contains("path", F.col("b")))
        step = cut_lineage(step)
        ended = step.filter("not _go").select("start", "path")
        done = ended if done is None else done.unionAll(ended)
        live = step.filter("_go").select("start", F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("tip"))
        if live.isEmpty():  # a walk never comes back, so all of them end
            return done


def calibration(df: DataFrame, p: str, y: str, buckets: int = 10) -> DataFrame:
    b = F.floor(F.col(p) * buckets + 0.5) / buckets
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))


def rank_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Area under the ROC curve as a rank sum.  Equal scores share their mean rank; only distinct scores are ordered."""
    g = df.groupBy(score).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))
    w = Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    return g.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The element at position n // 2 of the sorted values (0-based), from counts of distinct values that are combined before
    the shuffle: a hot group costs no more than its distinct values."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    p = c.select(*by, value, F.sum("_n").over(upto).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    return p.groupBy(*by).agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col(value))).alias("upper_median"))


def semi_partial(r_xy: Column, r_xz: Column, r_yz: Column) -> Column:
    """Correlation of y with what z leaves of x."""
    return F.when(r_xz * r_xz < 1, (r_xy - r_xz * r_yz) / F.sqrt(1 - r_xz * r_xz))
