"""Resolution of name variants: pairwise rule, greedy clusters, merged records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_accents, nominative
from weftline.functions.times import overlap
from weftline.operators.relational import jaccard


#: most choices that a best match is sought among in place
MAX_CHOICES = 20_000


def best_choice(df: DataFrame, name: str, choices: Sequence[str]) -> DataFrame:
    """``df`` with ``best``, the most similar other entry of a fixed list of choices, and its ``score``; null where there is none."""
    if len(choices) > MAX_CHOICES:
        raise ValueError(f"more than {MAX_CHOICES} choices")
    spark = df.sparkSession
    one = spark.createDataFrame([(list(choices),)], "_choices array<string>")  # bounded above
    q = F.lower(F.col(name))
    rated = F.transform(
        F.filter("_choices", lambda c: c != F.col(name)),
        lambda c: F.struct((-F.round(1 - F.levenshtein(q, F.lower(c)) / F.greatest(F.length(q), F.length(c)), 9)).alias("s"), c.alias("c")),
    )
    best = F.array_min(rated)
    return df.join(F.broadcast(one)).withColumn("_best", best).withColumn("best", F.col("_best.c")).withColumn("score", -F.col("_best.s")).drop("_choices", "_best")


def stems(name: Column) -> Column:
    """The parts of a name of more than one letter, folded, in the nominative."""
    parts = F.filter(F.split(F.lower(fold_accents(name)), r"[^\p{L}]+"), lambda x: F.length(x) > 1)
    return F.transform(parts, lambda x: nominative(F.regexp_replace(x, "σ$", "ς")))


def same_person(n1: Column, n2: Column, lo1: Column, hi1: Column, lo2: Column, hi2: Column, tolerance: int = 200, similarity: float = 0.5) -> Column:
    """Dates must not rule it out; then equal folded names, equal stems (of at least four letters), or enough shared stems."""
    f1, f2 = F.lower(fold_accents(n1)), F.lower(fold_accents(n2))
    s1, s2 = stems(n1), stems(n2)
    whole = (F.array_join(s1, " ") == F.array_join(s2, " ")) & (F.length(F.array_join(s1, " ")) >= 4)
    return overlap(lo1, hi1, lo2, hi2, tolerance) & ((f1 == f2) | whole | (jaccard(s1, s2) >= similarity))


def candidate_pairs(names: DataFrame, key: str, name: str, block: str | None = None) -> DataFrame:
    """Distinct pairs of rows (of one block) that share a stem: ``(a, b)`` with a < b.  The rule above can hold for no others
    except equal folded names, which share all stems."""
    t = names.select(F.col(key).alias("k"), F.col(block).alias("b") if block else F.lit("").alias("b"), F.explode(F.array_distinct(stems(F.col(name)))).alias("s"))
    left, right = t.withColumnRenamed("k", "ka"), t.withColumnRenamed("k", "kb")
    return left.join(right, ["b", "s"]).filter("ka < kb").select("ka", "kb").distinct()


def greedy_clusters(names: DataFrame, block: str, key: str, name_stems: str, count: str) -> DataFrame:
    """Greedy clusters per block: rows in falling count join the first cluster whose leader shares at least half of the stems.

    Order decides, so a block is resolved as a whole in one task; an index from stems to leaders keeps a row from being
    compared with leaders it shares nothing with.  Rows without a block stand alone.
    """
    kt = names.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([count, key], ascending=[False, True], kind="stable")
        leaders: list[tuple[object, frozenset]] = []
        index: dict[str, list[int]] = {}
        out = []
        for k, s in zip(pdf[key], pdf[name_stems]):
            own = frozenset(s)
            hits = Counter(i for w in own for i in index.get(w, ()))
            fit = [i for i, n in hits.items() if 2 * n >= len(own | leaders[i][1])]
            if fit:
                out.append(leaders[min(fit)][0])
                continue
            for w in own:
                index.setdefault(w, []).append(len(leaders))
            leaders.append((k, own))
            out.append(k)
        return pd.DataFrame({block: pdf[block].to_numpy(), key: pdf[key].to_numpy(), "leader": out})

    bt = names.schema[block].dataType.simpleString()
    alone = names.filter(F.col(block).isNull()).select(block, key, F.col(key).alias("leader"))
    inside = names.filter(F.col(block).isNotNull()).select(block, key, name_stems, count)
    return inside.groupBy(block).applyInPandas(run, f"{block} {bt}, {key} {kt}, leader {kt}").unionAll(alone)


def merge_records(df: DataFrame, by: str, name: str, count: str, lo: str, hi: str) -> DataFrame:
    """One record per cluster: the most mentioned name, all variants in order, the mentions' sum and the widest range."""
    return df.groupBy(by).agg(
        F.max_by(name, F.struct(F.coalesce(count, F.lit(0)), F.col(name))).alias("canonical_name"), F.array_sort(F.collect_set(name)).alias("variants"),
        F.sum(F.coalesce(count, F.lit(0))).alias("mention_count"), F.min(lo).alias("year_from"), F.max(hi).alias("year_to"),
    )


def pipeline_names(found: Column, explicit: Column, sender: Column, recipient: Column) -> Column:
    """All names of a document, in order of their sources, each once; nulls and blanks out."""
    every = F.concat(F.coalesce(explicit, F.array()), F.coalesce(found, F.array()), F.array(sender, recipient))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.trim(x) != "")))


def reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: ``n_before``, ``n_after`` and by how many per cent resolution made the rows fewer (null without rows)."""
    n = before.agg(F.count("*").alias("n_before")).crossJoin(after.agg(F.count("*").alias("n_after")))
    return n.withColumn("reduction_pct", F.when(F.col("n_before") > 0, 100.0 * (1 - F.col("n_after") / F.col("n_before"))))


def through_cache(df: DataFrame, key: str, cache: DataFrame, value: str, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``value`` and ``cached``, and the cache for the next run.

    ``cache`` and what ``fetch`` returns have ``(key, value)``, each key once.  ``fetch`` gets the distinct keys that the
    cache lacks, and no others; keys that it does not return, or returns without a value, stay null and uncached.
    """
    missing = df.select(key).filter(F.col(key).isNotNull()).distinct().join(cache.select(key), key, "left_anti")
    new = fetch(missing).select(key, value).filter(F.col(value).isNotNull())
    grown = cache.select(key, value, F.lit(True).alias("cached")).unionByName(new.withColumn("cached", F.lit(False)))
    return df.join(grown, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False))), grown.select(key, value)
