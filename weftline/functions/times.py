"""Date and time expressions.  Time zones never enter: local hours are fixed offsets of UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour_key(c: Column) -> Column:
    """A UTC hour out of texts such as ``2026-01-05T07``, ``2026-01-05T07:00`` or full timestamps; null for anything else."""
    head = F.replace(F.substring(c, 1, 13), F.lit("T"), F.lit(" "))
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}$"), F.try_to_timestamp(F.concat(head, F.lit(":00:00")), F.lit("yyyy-MM-dd HH:mm:ss")))


def local_hour(ts: Column, offset: int) -> Column:
    """Hour of the day at a fixed offset of UTC."""
    return F.pmod(F.hour(ts) + F.lit(offset), F.lit(24))


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def cycle(value: Column, length: float) -> tuple[Column, Column]:
    """Sine and cosine of a position on a cycle."""
    angle = value * F.lit(2 * 3.141592653589793 / length)
    return F.sin(angle), F.cos(angle)


def midpoint(a: Column, b: Column) -> Column:
    """The floor of the middle of two years; a missing end is the other one."""
    return F.floor((F.coalesce(a, b) + F.coalesce(b, a)) / 2).cast("int")


def decade(year: Column) -> Column:
    """The decade's first year; years before the era count downwards."""
    return (F.floor(year / 10) * 10).cast("int")


#: fixed values: the first years of the periods after the first one
PERIODS = ((-30, "Ptolemaic"), (284, "Early Roman"), (641, "Late Roman"), (None, "Byzantine/Islamic"))


def period(year: Column, bounds=PERIODS) -> Column:
    """The historical period of a year, each bound included; null without a year."""
    out = F.lit(bounds[-1][1])
    for last, name in reversed(bounds[:-1]):
        out = F.when(year <= last, name).otherwise(out)
    return F.when(year.isNotNull(), out)


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column, tolerance: int = 0) -> Column:
    """Whether two closed ranges meet when each may be ``tolerance`` off; unknown ranges do not speak against it."""
    return F.coalesce((lo1 - tolerance <= hi2) & (lo2 - tolerance <= hi1), F.lit(True))


def tolerant_date(c: Column) -> Column:
    """A date out of an ISO timestamp or date; else the text's first ten letters are tried."""
    return F.coalesce(F.try_to_timestamp(c).cast("date"), F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd"))))


def mail_date(c: Column) -> Column:
    """A timestamp out of an RFC 822 date; null where it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT|Z)$", "+0000")
    return F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")))


def month_chunks(start: Column, end: Column) -> Column:
    """Array of (month, first day, last day) of the months of a closed range of dates, clipped to it.  A turned-round range is an error."""
    ok = F.when(end < start, F.raise_error(F.lit("the range ends before it starts")).cast("date")).otherwise(start)
    months = F.sequence(F.trunc(ok, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.date_format(m, "yyyy-MM").alias("month"), F.greatest(m, start).alias("first_day"), F.least(F.last_day(m), end).alias("last_day")))


def day_chunks(start: Column, end: Column, days: int) -> Column:
    """Array of (first day, day after the last) of consecutive pieces of ``days`` of a half-open range."""
    firsts = F.sequence(start, F.date_sub(end, 1), F.expr(f"interval {days} day"))
    return F.transform(firsts, lambda d: F.struct(d.alias("first_day"), F.least(F.date_add(d, days), end).alias("next_day")))


def last_months(end_month: Column, n: int) -> Column:
    """First days of the ``n`` months that end with ``end_month``, ascending."""
    m = F.trunc(end_month, "month")
    return F.sequence(F.add_months(m, -(n - 1)), m, F.expr("interval 1 month"))


def lead_hours(issued: Column, gate: Column) -> Column:
    """Hours from the gate back to the issue: positive if the value was known in time."""
    return (F.unix_timestamp(gate) - F.unix_timestamp(issued)) / 3600
