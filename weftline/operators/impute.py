"""Filling missing values from records of the same group or time, with masks of what was filled.

Numerics follow a mixed-effects model ``y = mu + u[group] + v[period] + e``: group and period are
random effects, their variances come from the method of moments, and each effect is the mean residual
shrunk by ``n / (n + var_e / var_effect)``.  Two sweeps of backfitting separate group from period.
Categories follow a multinomial logistic model: a softmax over indicators of every group column and of the period, hashed
to a bounded number of weights that a ridge draws towards the overall shares, fitted by distributed gradients.

All statistics are taken over all rows, but from tables of cells (group, period) that are aggregated
map-side first; hot groups therefore never meet in one task as raw rows.

Defined results
---------------
* missing is: null, NaN, an infinity, a number outside ``valid``, a text that is blank or, trimmed and
  in lower case, in ``tokens``;
* a group or period without any real value (or a null one) has effect 0: the other effects decide;
* if no row has a real value, nothing can be filled: the value stays null and the mask is true;
* a filled number never leaves its ``valid`` range;
* among equally likely categories the first in order wins; repeated rows count as often as they occur;
* an input column with the name of an output column is kept under its name plus ``_in``;
* a row whose key is null is filled all the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import FeatureHasher
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut_lineage

#: texts that stand in for a missing value (compared trimmed, in lower case)
MISSING_TOKENS = ("", "-", "--", "?", "n/a", "n.a.", "na", "nan", "none", "null", "nil", "unknown", "missing", "tbd", "not available")


@dataclass(frozen=True)
class NumericField:
    """A numeric field, the column that groups it and the closed range of its real values."""

    field: str
    group: str
    valid: tuple[float, float]


@dataclass(frozen=True)
class CategoryField:
    """A categorical field, the columns whose groups inform it and the texts that mean 'missing'."""

    field: str
    groups: tuple[str, ...]
    tokens: tuple[str, ...] = MISSING_TOKENS


def number_missing(c: Column, valid: tuple[float, float]) -> Column:
    """True where a number is no real value; never null."""
    return F.coalesce(F.isnan(c) | ~c.between(F.lit(float(valid[0])), F.lit(float(valid[1]))), F.lit(True))


def text_missing(c: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """True where a text is no real value; never null."""
    return F.coalesce(F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$", "")).isin(list(tokens)), F.lit(True))


def _moments(cells: DataFrame, by: str, effect_free: Column) -> tuple[float, float]:
    """(residual variance, effect variance) of one random effect from cell sums; 0.0 where they can't be told."""
    g = (
        cells.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(F.sum("n").alias("n"), F.sum(effect_free).alias("s"), F.sum("ss").alias("ss"))
    )
    r = g.agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"),
        F.sum("s").alias("s"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not r["n"] or r["n"] <= r["k"] or r["k"] < 2:
        return 0.0, 0.0
    n, k = float(r["n"]), float(r["k"])
    within = max(0.0, (r["ss"] - r["b"]) / (n - k))
    between = (r["b"] - r["s"] * r["s"] / n) - (k - 1) * within
    return within, max(0.0, between / (n - float(r["nn"]) / n))


def _effects(cells: DataFrame, by: str, other: DataFrame | None, other_by: str, mu: float) -> DataFrame:
    """Shrunk effects ``(by, eff)``: mean residuals after ``mu`` and the other effect, drawn towards 0."""
    c = cells
    if other is not None:
        c = c.join(other.withColumnRenamed("eff", "o"), other_by, "left")
    else:
        c = c.withColumn("o", F.lit(0.0))
    off = F.lit(mu) + F.coalesce("o", F.lit(0.0))
    res = c.select(by, "n", (F.col("s") - F.col("n") * off).alias("r"), (F.col("ss") - 2 * off * F.col("s") + F.col("n") * off * off).alias("ss"))
    var_e, var_u = _moments(res, by, F.col("r"))
    g = res.filter(F.col(by).isNotNull()).groupBy(by).agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    weight = F.lit(0.0) if var_u <= 0 else F.col("n") / (F.col("n") + F.lit(var_e / var_u))
    return g.select(by, (F.col("r") / F.col("n") * weight).alias("eff"))


def fit_mixed(df: DataFrame, fields: Sequence[NumericField], period: Column, sweeps: int = 2) -> tuple[float | None, DataFrame, DataFrame]:
    """Fit one model to all ``fields`` (they share groups and scale): (mu, effects ``(grp, eff)``, effects ``(per, eff)``)."""
    one = F.explode(F.array(*[F.struct(F.col(f.group).alias("grp"), F.when(~number_missing(F.col(f.field), f.valid), F.col(f.field)).alias("y")) for f in fields]))
    cells = (
        df.select(period.alias("per"), one.alias("x"))
        .select("x.grp", "per", "x.y")
        .filter(F.col("y").isNotNull())
        .groupBy("grp", "per")
        .agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss"))
    )
    cells = cut_lineage(cells)
    tot = cells.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not tot["n"]:
        none = cells.select("grp", F.lit(0.0).alias("eff"))
        return None, none, cells.select("per", F.lit(0.0).alias("eff"))
    mu = float(tot["s"] / tot["n"])
    groups = periods = None
    for _ in range(sweeps):
        groups = cut_lineage(_effects(cells, "grp", periods, "per", mu))
        periods = cut_lineage(_effects(cells, "per", groups, "grp", mu))
    return mu, groups, periods


def _guess_category(df: DataFrame, out: DataFrame, spec: CategoryField, period: Column, name: str, ridge: float, buckets: int, max_classes: int) -> DataFrame:
    """``out`` with the likeliest category of every row in column ``name``, by a multinomial model fitted on the real ones."""
    real = ~text_missing(F.col(spec.field), spec.tokens)
    prior = df.filter(real).groupBy(F.col(spec.field).alias("c")).agg(F.count("*").alias("n")).orderBy("c").limit(max_classes + 1).collect()
    if len(prior) > max_classes:
        raise ValueError(f"{spec.field} has more than {max_classes} categories; raise max_classes or group them first")
    classes = [r["c"] for r in prior]
    if len(classes) < 2:
        return out.withColumn(name, F.lit(classes[0] if classes else None).cast("string"))
    dims = {f"__wl_d{i}": c.cast("string") for i, c in enumerate([*[F.col(g) for g in spec.groups], period])}
    number = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    hasher = FeatureHasher(inputCols=list(dims), outputCol="__wl_x", numFeatures=buckets)
    cells = df.filter(real).select(*[c.alias(n) for n, c in dims.items()], number[F.col(spec.field)].alias("label")).groupBy(*dims, "label").agg(F.count("*").cast("double").alias("w"))
    fit = LogisticRegression(
        family="multinomial", featuresCol="__wl_x", labelCol="label", weightCol="w", regParam=ridge, standardization=False, maxIter=25, tol=1e-4,
        predictionCol="__wl_k", rawPredictionCol="__wl_raw", probabilityCol="__wl_prob",
    )
    model = fit.fit(hasher.transform(cut_lineage(cells)))
    scored = model.transform(hasher.transform(out.withColumns(dims)))
    guess = F.get(F.array(*[F.lit(c) for c in classes]), F.col("__wl_k").cast("int"))
    return scored.withColumn(name, guess).drop(*dims, "__wl_x", "__wl_raw", "__wl_prob", "__wl_k")


def fill_missing(
    df: DataFrame, key: str, *, numerics: Sequence[NumericField] = (), categories: Sequence[CategoryField] = (), time: str | None = None,
    period: str = "week", digits: int | None = None, ridge: float = 1e-4, buckets: int = 1 << 14, max_classes: int = 100,
) -> DataFrame:
    """``df`` with, per field, ``<field>_filled`` and the mask ``<field>_missing``.  ``key`` is unique per row.

    ``numerics`` share one model (``home_x`` and ``away_x`` of the same entities, say).  ``time`` is a date or
    timestamp column, cut to ``period`` (as in date_trunc); null or absent: no time effect.
    """
    per = F.date_trunc(period, F.col(time)) if time else F.lit(None).cast("timestamp")
    out = df
    made = [f"{f.field}_{x}" for f in [*numerics, *categories] for x in ("filled", "missing")]
    for c in made:
        if c in df.columns:
            out = out.withColumnRenamed(c, f"{c}_in")
    src = df
    if numerics:
        mu, groups, periods = fit_mixed(src, numerics, per)
        at = periods.select(F.col("per").alias("__wl_per"), F.col("eff").alias("__wl_v"))
        out = out.withColumn("__wl_per", per).join(at, "__wl_per", "left")
        for i, f in enumerate(numerics):
            eff = groups.select(F.col("grp").alias(f"__wl_g{i}"), F.col("eff").alias(f"__wl_u{i}"))
            out = out.withColumn(f"__wl_g{i}", F.col(f.group)).join(eff, f"__wl_g{i}", "left")
            guess = F.lit(mu) + F.coalesce(f"__wl_u{i}", F.lit(0.0)) + F.coalesce("__wl_v", F.lit(0.0)) if mu is not None else F.lit(None).cast("double")
            if digits is not None:
                guess = F.round(guess, digits)
            guess = F.when(guess.isNotNull(), F.greatest(F.least(guess, F.lit(float(f.valid[1]))), F.lit(float(f.valid[0]))))
            lost = number_missing(F.col(f.field), f.valid)
            out = out.withColumn(f"{f.field}_filled", F.when(lost, guess).otherwise(F.col(f.field))).withColumn(f"{f.field}_missing", lost)
        out = out.drop("__wl_per", "__wl_v", *[f"__wl_g{i}" for i in range(len(numerics))], *[f"__wl_u{i}" for i in range(len(numerics))])
    for s in categories:
        lost = text_missing(F.col(s.field), s.tokens)
        out = _guess_category(src, out, s, per, "__wl_guess", ridge, buckets, max_classes)
        out = out.withColumn(f"{s.field}_filled", F.when(lost, F.col("__wl_guess")).otherwise(F.col(s.field))).withColumn(f"{s.field}_missing", lost).drop("__wl_guess")
    return out


def filled_cells(filled: DataFrame, key: str, fields: Sequence[str], name: str = "field_name") -> DataFrame:
    """``(key, field, value)``: one row for each cell that carried no real value, with the text of what now stands there.

    A cell counts if its mask is set and filling changed it, or could not fill it (then ``value`` is null)."""

    def cell(f: str) -> Column:
        now = F.col(f"{f}_filled")
        changed = ~F.col(f).eqNullSafe(now) | now.isNull()
        return F.when(F.col(f"{f}_missing") & changed, F.struct(F.lit(f).alias(name), now.cast("string").alias("value")))

    return filled.select(key, F.inline(F.array_compact(F.array(*[cell(f) for f in fields]))))
