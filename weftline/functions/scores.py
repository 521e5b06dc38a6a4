"""Arithmetic and conditional expressions: clamps, piecewise maps, odds, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def linear_map(x: Column, intercept: float, slope: float, lo: float = 0.0, hi: float = 100.0) -> Column:
    """A clamped line; null stays null."""
    return F.when(x.isNotNull(), clamp(F.lit(intercept) + F.lit(slope) * x, lo, hi))


def piecewise(x: Column, pieces: Sequence[tuple[float, float, float]], lo: float = 0.0, hi: float = 100.0) -> Column:
    """Lines by interval: ``(upper bound, intercept, slope)`` in order, the last one with an infinite bound.  Jumps are allowed."""
    out = F.lit(pieces[-1][1]) + F.lit(pieces[-1][2]) * x
    for bound, a, b in reversed(pieces[:-1]):
        out = F.when(x <= bound, F.lit(a) + F.lit(b) * x).otherwise(out)
    return F.when(x.isNotNull(), clamp(out, lo, hi))


def grade(score: Column, steps: Sequence[tuple[float, str]], lowest: str, unknown: str = "?") -> Column:
    """A letter by falling thresholds."""
    out = F.lit(lowest)
    for bound, name in reversed(list(steps)):
        out = F.when(score >= bound, name).otherwise(out)
    return F.when(score.isNull(), unknown).otherwise(out)


def share_between(x: Column, lo: float, hi: float) -> Column:
    return (x - lo) / (hi - lo)


def composite(a: Column, b: Column) -> Column:
    """The mean of two scores, or the one there is."""
    return F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b))


def decimal_odds(american: Column) -> Column:
    return F.when(american > 0, 1 + american / 100).otherwise(1 + 100 / F.abs(american))


def implied_probability(american: Column) -> Column:
    return F.when(american > 0, 100 / (american + 100)).otherwise(F.abs(american) / (F.abs(american) + 100))


def american_odds(p: Column) -> Column:
    """Fair American odds of a probability; null at and beyond the ends."""
    return F.when((p <= 0) | (p >= 1), None).when(p >= 0.5, -F.round(100 * p / (1 - p))).otherwise(F.round(100 * (1 - p) / p))


def growth_fraction(p: Column, decimal: Column) -> Column:
    """The stake that maximises log growth, never negative."""
    b = decimal - 1
    return F.greatest(F.lit(0.0), F.when(b > 0, (b * p - (1 - p)) / b).otherwise(F.lit(0.0)))


def expected_value(p: Column, american: Column, stake: float = 100.0) -> Column:
    return (p * (decimal_odds(american) - 1) - (1 - p)) * F.lit(stake)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.lit(1 - eps), F.greatest(F.lit(eps), p))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def safe_ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def pair_features(home_for: Column, away_for: Column, home_against: Column, away_against: Column, home_pace: Column, away_pace: Column, home_tempo: Column, away_tempo: Column) -> list[Column]:
    """Twelve features of a pairing: levels of both sides, their differences and sums, shares of pace and tempo."""
    pace = home_pace + away_pace
    return [
        home_for.alias("home_for"), away_for.alias("away_for"), home_against.alias("home_against"), away_against.alias("away_against"), F.when(pace > 0, home_pace / pace).otherwise(0.5).alias("pace_share"),
        (home_for - away_for).alias("diff"), (home_for + away_for).alias("total"), (home_for - home_against).alias("home_net"), (away_for - away_against).alias("away_net"),
        home_tempo.alias("home_tempo"), away_tempo.alias("away_tempo"), (away_tempo - home_tempo).alias("tempo_diff"),
    ]


def totals_features(home_for: Column, away_for: Column, home_against: Column, away_against: Column) -> list[Column]:
    """Nine features of the sum of both scores."""
    home, away = home_for - home_against, away_for - away_against
    return [
        home_for.alias("home_for"), away_for.alias("away_for"), home_against.alias("home_against"), away_against.alias("away_against"), (home_for + away_for).alias("total"),
        home.alias("home_net"), away.alias("away_net"), ((home + away) / 2).alias("mean_net"), ((home_against + away_against) / 2).alias("mean_against"),
    ]


def both_ways(p: Column, turned: Column) -> Column:
    """A probability freed of which side was named first: the mean of it and of what the turned-round pairing leaves."""
    return (p + 1 - turned) / 2


def damped(x: Column, factor: float) -> Column:
    return x * F.lit(factor)


def milli(x: Column) -> Column:
    """Thousandths of a unit in units."""
    return x / 1000
