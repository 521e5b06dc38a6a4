"""Set-similarity join by prefix filtering, entirely inside the JVM.

Tokens are ordered by global rarity (counted over all rows of both sides).  Two sets whose Jaccard
similarity reaches ``t`` must share a token among the first ``n - ceil(t*n) + 1`` of each, so only those
prefixes are joined; a length filter and a positional filter drop most pairs, and the exact Jaccard
similarity of what is left is computed from the full sets.  No link is lost and no cap is set.

Defined results
---------------
* rows with a null id, a null set or an empty set have no partner;
* repeated tokens within a set count once; repeated ids with the same set give repeated pairs once;
* ties are all kept: choosing the best partner is left to the caller.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ordered(df: DataFrame, freq: DataFrame, t: float) -> DataFrame:
    """(id, toks, n) with tokens in order of rarity, exploded to prefix rows (id, toks, n, tok, pos)."""
    each = df.select("id", F.explode("toks").alias("tok"))
    sets = (
        each.join(freq, "tok")
        .groupBy("id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "tok"))), lambda x: x["tok"]).alias("toks"))
        .withColumn("n", F.size("toks"))
    )
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(t) - F.lit(1e-9)).cast("int") + 1
    return sets.select("id", "toks", "n", F.posexplode(F.slice("toks", F.lit(1), keep)).alias("pos", "tok"))


def set_similarity_join(left: DataFrame, right: DataFrame, t: float, *, id_col: str = "id", tokens: str = "toks") -> DataFrame:
    """All pairs ``(left_id, right_id, jaccard)`` with Jaccard similarity of at least ``t`` (0 < t <= 1)."""
    if not 0 < t <= 1:
        raise ValueError("t must be in (0, 1]")
    pick = lambda d: (
        d.select(F.col(id_col).alias("id"), F.array_distinct(tokens).alias("toks"))
        .filter(F.col("id").isNotNull() & (F.size("toks") > 0))
        .dropDuplicates(["id"])
    )
    a, b = pick(left), pick(right)
    freq = a.select(F.explode("toks").alias("tok")).unionAll(b.select(F.explode("toks").alias("tok"))).groupBy("tok").agg(F.count("*").alias("f"))
    x = _ordered(a, freq, t).select(F.col("id").alias("left_id"), F.col("toks").alias("lt"), F.col("n").alias("ln"), F.col("pos").alias("lp"), "tok")
    y = _ordered(b, freq, t).select(F.col("id").alias("right_id"), F.col("toks").alias("rt"), F.col("n").alias("rn"), F.col("pos").alias("rp"), "tok")
    need = F.ceil((F.col("ln") + F.col("rn")) * F.lit(t / (1 + t)) - F.lit(1e-9))
    reach = F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp"))  # no token before the first shared one counts
    pairs = (
        x.join(y, "tok")
        .filter((F.col("rn") >= F.col("ln") * F.lit(t) - 1e-9) & (F.col("ln") >= F.col("rn") * F.lit(t) - 1e-9))
        .withColumn("both", F.array_intersect("lt", "rt"))
        # each pair is kept at its first shared prefix token only, where the positional bound holds
        .filter((F.get("both", F.lit(0)) == F.col("tok")) & (reach >= need))
    )
    inter = F.size("both")
    jac = inter / (F.col("ln") + F.col("rn") - inter)
    return pairs.select("left_id", "right_id", jac.alias("jaccard")).filter(F.col("jaccard") >= t - 1e-12)


def prefix_length(n: int, t: float) -> int:
    """How many of the rarest tokens of a set of ``n`` must be looked at (for tests)."""
    return n - math.ceil(t * n - 1e-9) + 1
