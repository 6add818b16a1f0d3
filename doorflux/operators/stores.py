"""Comparison of stores, and the list of their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.functions.periods import Request
from doorflux.functions.rounding import round_exact
from doorflux.operators.filters import business_days, prefilter_store, with_store_names
from doorflux.operators.normalize import Traffic


def store_totals(traffic: Traffic, request: Request) -> DataFrame:
    """``(x, y)``: visitors per store name; unknown stores share the NULL name.

    Rows are summed by store id before any join, so the join and the second sum
    see one row per store however many records a store has.
    """
    rows = prefilter_store(traffic, business_days(traffic, request), request)
    by_id = rows.groupBy("store_id").agg(F.sum("in_count").alias("in_count"))
    return (
        with_store_names(traffic, by_id, request)
        .groupBy(F.col("store_name").alias("x"))
        .agg(F.sum("in_count").alias("y"))
    )


def store_comparison(traffic: Traffic, request: Request) -> DataFrame:
    """Store totals, the largest first."""
    return store_totals(traffic, request).orderBy(F.desc("y"), F.asc_nulls_last("x"))


def store_share(traffic: Traffic, request: Request) -> DataFrame:
    """Each store's part of all visitors in percent, to one decimal.

    The overall total is a scalar subquery, so no window gathers all stores in
    one task.
    """
    totals = store_totals(traffic, request)
    whole = totals.agg(F.sum("y")).scalar()
    percent = F.col("y").cast("double") * 100.0 / F.nullif(whole, F.lit(0)).cast("double")
    share = F.coalesce(round_exact(F.col("percent"), ties="up"), F.lit(0.0))
    return totals.select("x", "y", percent.alias("percent")).select(
        "x", "y", share.alias("share_pct")
    )


def store_names(stores: DataFrame) -> DataFrame:
    """Distinct store names in order."""
    return stores.select("store_name").distinct().orderBy(F.asc_nulls_last("store_name"))
