"""Scalar date expressions. The "as of" date is always a parameter, never today."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_MINUTE = "yyyy-MM-dd'T'HH:mm"


def lenient_day(text: Column) -> Column:
    """Date of a text, null when it is not one."""
    return text.try_cast("date")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end; null when either text is no date."""
    return F.datediff(lenient_day(end), lenient_day(start))


def step_count(start: Column, end: Column) -> Column:
    """1 when both dates are known and equal, otherwise 2."""
    return F.when(lenient_day(start) == lenient_day(end), 1).otherwise(2)


def year_flag(day: Column, years: Sequence[int] = (2022,)) -> Column:
    return F.when(F.year(day).isin(*years), 1).otherwise(0)


def period_label(day: Column, years: Sequence[int], inside: str, outside: str) -> Column:
    """Label by year; a null date falls outside."""
    return F.when(F.year(day).isin(*years), F.lit(inside)).otherwise(F.lit(outside))


def month_key(moment: Column, missing: str = "Data não encontrada") -> Column:
    """``MMyyyy`` display key of an ISO text or time value."""
    return F.coalesce(F.date_format(moment.try_cast("timestamp"), "MMyyyy"), F.lit(missing))


def day_text(moment: Column) -> Column:
    """First ten characters of an ISO text."""
    return F.substring(moment, 1, 10)


def iso_minute(text: Column) -> Column:
    """``yyyy-MM-ddTHH:mm`` to a time value, null when it does not fit."""
    return F.try_to_timestamp(text, F.lit(ISO_MINUTE)).cast("timestamp_ntz")


def month_days(start: Column, end: Column, day: int = 15, as_of: Column | None = None) -> Column:
    """The given day of every month from start's to end's, none after ``as_of``."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    days = F.transform(months, lambda m: F.date_add(m.cast("date"), day - 1))
    return days if as_of is None else F.filter(days, lambda d: d <= as_of)
