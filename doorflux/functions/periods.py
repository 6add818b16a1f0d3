"""Requests, business-day ranges, time buckets, labels and date presets.

All arithmetic stays on ``timestamp_ntz`` and ``date``, so no result depends on
the session time zone.
"""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorflux.config import BusinessRules

ALL_STORES = "all"

# The bucket size of each period, and the label of each bucket.
BUCKET_UNIT = {"year": "month", "month": "day", "week": "day", "day": "hour"}
DEFAULT_UNIT = "day"
PEAK_LABEL = {"day": "hour_of_day", "week": "day_of_month", "month": "day_of_month", "year": "month_name"}
DEFAULT_PEAK_LABEL = "day_of_month"


@dataclass(frozen=True)
class Request:
    """What a dashboard user asks for: a period, two dates and a store name."""

    period: str
    start_date: date
    end_date: date
    store: str = ALL_STORES

    @classmethod
    def of(cls, period: str, start: str, end: str, store: str = ALL_STORES) -> Request:
        return cls(period, date.fromisoformat(start), date.fromisoformat(end), store)

    @property
    def unit(self) -> str:
        return BUCKET_UNIT.get(self.period, DEFAULT_UNIT)

    @property
    def peak_label(self) -> str:
        return PEAK_LABEL.get(self.period, DEFAULT_PEAK_LABEL)

    def previous(self) -> Request | None:
        """The same dates one period earlier; None for an unknown period."""
        start = shift_back(self.start_date, self.period)
        end = shift_back(self.end_date, self.period)
        if start is None or end is None:
            return None
        return Request(self.period, start, end, self.store)


def shift_back(day: date, period: str) -> date | None:
    """``day`` one period earlier, cut to the end of a shorter month."""
    if period in ("day", "week"):
        return day - timedelta(days=1 if period == "day" else 7)
    if period not in ("month", "year"):
        return None
    months = day.year * 12 + day.month - 1 - (1 if period == "month" else 12)
    year, month = months // 12, months % 12 + 1
    return date(year, month, min(day.day, calendar.monthrange(year, month)[1]))


@dataclass(frozen=True)
class Window:
    """A half-open time range ``[start, end)`` as timestamp text."""

    start: str
    end: str

    def contains(self, moment: Column) -> Column:
        return (moment >= ntz(self.start)) & (moment < ntz(self.end))

    def partitions(self, year: Column, month: Column) -> Column:
        """The (year, month) partitions the range touches: Spark does not derive
        them from a predicate on the timestamp."""
        first_year, first_month = int(self.start[:4]), int(self.start[5:7])
        last_year, last_month = int(self.end[:4]), int(self.end[5:7])
        from_start = (year > first_year) | ((year == first_year) & (month >= first_month))
        to_end = (year < last_year) | ((year == last_year) & (month <= last_month))
        return from_start & to_end & year.between(first_year, last_year)


    def cut_day(self, rules: BusinessRules) -> Window | None:
        """The business day that the range ends within; None if it ends with one."""
        opening = timedelta(hours=rules.working_hour_start)
        end = datetime.fromisoformat(self.end) - opening
        if end.time() == time():
            return None
        first = datetime.combine(end.date(), time()) + opening
        return Window(str(first), str(first + timedelta(days=1)))


def business_window(start: date, end: date, rules: BusinessRules) -> Window:
    """From opening on ``start`` to closing in the night after ``end``."""
    last = end + timedelta(days=1)
    return Window(
        f"{start.isoformat()} {rules.working_hour_start:02d}:00:00",
        f"{last.isoformat()} {rules.working_hour_end:02d}:00:00",
    )


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


#: Seconds of the units an interval may be given in.
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def interval(text: str) -> Column:
    """A span such as ``3 days`` or ``1 hour 30 minutes``; an error if it is none."""
    found = re.fullmatch(r"\s*(?:\d+\s+[a-z]+\s*)+", text.lower())
    pairs = re.findall(r"(\d+)\s+([a-z]+)", text.lower())
    if not found or any(unit.removesuffix("s") not in _UNITS for _, unit in pairs):
        raise ValueError(f"not an interval: {text!r}")
    seconds = sum(int(count) * _UNITS[unit.removesuffix("s")] for count, unit in pairs)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def hours(count: int | Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(count))


def bucket(moment: Column, unit: str) -> Column:
    """The start of the hour, day or month a moment lies in."""
    day = moment.cast("date")
    if unit == "hour":
        return day.cast("timestamp_ntz") + hours(F.hour(moment))
    if unit == "day":
        return day.cast("timestamp_ntz")
    if unit == "month":
        return F.trunc(day, "month").cast("timestamp_ntz")
    raise ValueError(f"unknown bucket unit: {unit!r}")


def label(moment: Column, style: str) -> Column:
    """A bucket start as text; ``style`` is a bucket unit or a peak label."""
    text = moment.cast("string")  # yyyy-MM-dd HH:mm:ss
    day, month = F.substring(text, 9, 2), F.substring(text, 6, 2)
    if style == "hour":
        return F.concat(F.substring(text, 1, 13), F.lit(":00"))
    if style == "day":
        return F.substring(text, 1, 10)
    if style == "month":
        return F.substring(text, 1, 7)
    if style == "hour_of_day":
        return F.substring(text, 12, 5)
    if style == "day_of_month":
        return F.concat(day, F.lit("/"), month)
    if style == "month_name":
        return F.concat(F.lit("Tháng "), month)
    raise ValueError(f"unknown label style: {style!r}")


def preset_range(period: Column, as_of: Column) -> tuple[Column, Column]:
    """First and last date of the day, week (Monday on), month or year of ``as_of``.

    The period ``default`` is the opening view: first of the month to ``as_of``.
    """
    month_start = F.trunc(as_of, "month")
    week_start = F.date_sub(as_of, F.weekday(as_of))
    year_start = F.trunc(as_of, "year")
    first = (
        F.when(period == "week", week_start)
        .when(period.isin("month", "default"), month_start)
        .when(period == "year", year_start)
        .otherwise(as_of)
    )
    last = (
        F.when(period == "week", F.date_add(week_start, 6))
        .when(period == "month", F.last_day(as_of))
        .when(period == "year", F.last_day(F.add_months(year_start, 11)))
        .otherwise(as_of)
    )
    return first, last


def preset_request(period: str, as_of: date, store: str = ALL_STORES) -> Request:
    """The request a user gets by choosing a period on the day ``as_of``.

    ``default`` is the opening view: the days of the month up to ``as_of``.
    """
    if period == "week":
        start = as_of - timedelta(days=as_of.weekday())
        end = start + timedelta(days=6)
    elif period == "month":
        start = as_of.replace(day=1)
        end = as_of.replace(day=calendar.monthrange(as_of.year, as_of.month)[1])
    elif period == "year":
        start, end = date(as_of.year, 1, 1), date(as_of.year, 12, 31)
    elif period == "default":
        start, end = as_of.replace(day=1), as_of
    else:
        start = end = as_of
    return Request(period, start, end, store)
