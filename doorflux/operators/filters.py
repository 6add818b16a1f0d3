"""Range and store filters of a request."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import BusinessRules
from doorflux.functions.periods import ALL_STORES, Request, Window, business_window
from doorflux.operators.normalize import Traffic


def window_of(request: Request, rules: BusinessRules) -> Window:
    return business_window(request.start_date, request.end_date, rules)


def previous_window(request: Request, rules: BusinessRules) -> Window | None:
    previous = request.previous()
    return None if previous is None else window_of(previous, rules)


def counts_in(traffic: Traffic, windows: Iterable[Window | None], unit: str | None = None) -> DataFrame:
    """The counts of one or more ranges, for all stores.

    Sums of business days serve the days that lie whole in their range, if the traffic has
    such sums and the ``unit`` of its buckets is no hour; hours (or records) serve the last
    day of each range, which ends before the next opening. A day that two ranges cut
    differently comes in hours for both.
    """
    ranges = [window for window in windows if window is not None]
    rows = traffic.counts.filter(_in_any(traffic.counts, ranges))
    if traffic.days is None or unit in (None, "hour"):
        return rows
    cut = [day for day in (window.cut_day(traffic.rules) for window in ranges) if day is not None]
    in_hours = reduce(Column.__or__, [day.contains(F.col("record_time")) for day in cut], F.lit(False))
    pruned = _in_any(rows, cut) if cut else F.lit(False)
    names = ["record_time", "store_id", "in_count", "out_count", *[n for n in ("year", "month") if n in rows.columns]]
    whole = traffic.days.filter(_in_any(traffic.days, ranges) & ~in_hours)
    return rows.filter(pruned).select(*names).unionByName(whole.select(*names))


def _in_any(df: DataFrame, windows: list[Window]) -> Column:
    return reduce(Column.__or__, [_in_range(df, window) for window in windows], F.lit(False))


def _in_range(df: DataFrame, window: Window) -> Column:
    inside = window.contains(F.col("record_time"))
    if {"year", "month"} <= set(df.columns):
        inside = inside & window.partitions(F.col("year"), F.col("month"))
    return inside


def business_days(traffic: Traffic, request: Request) -> DataFrame:
    """The counts of the request's range, for all stores."""
    return counts_in(traffic, [window_of(request, traffic.rules)], request.unit)


def with_store_names(traffic: Traffic, by_store: DataFrame, request: Request) -> DataFrame:
    """Name the stores of rows already summed by store id, and apply the filter.

    Without a filter unknown stores keep a NULL name; a filter drops them.
    """
    if request.store == ALL_STORES:
        return by_store.join(traffic.stores, "store_id", "left")
    wanted = traffic.stores.filter(F.col("store_name") == request.store)
    return by_store.join(wanted, "store_id", "inner")


def prefilter_store(traffic: Traffic, df: DataFrame, request: Request) -> DataFrame:
    """Only the rows of the chosen store, before anything is summed.

    A semi-join with the wanted stores: Spark broadcasts them where it finds them
    small, and a runtime filter on the store id reaches the scan of a large table.
    """
    if request.store == ALL_STORES:
        return df
    wanted = traffic.stores.filter(F.col("store_name") == request.store)
    return df.join(wanted.select("store_id"), "store_id", "left_semi")


def of_store(view: DataFrame, store: str) -> DataFrame:
    """Rows of the normalised view for one store name, or all of them."""
    return view if store == ALL_STORES else view.filter(F.col("store_name") == store)
