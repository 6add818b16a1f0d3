"""Time-bucket sums, the trend series and the hourly rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import BusinessRules
from doorflux.functions.periods import ALL_STORES, Request, bucket, label
from doorflux.operators.filters import business_days, prefilter_store, with_store_names
from doorflux.operators.normalize import Traffic, business_time, clock_time


def business_bucket(unit: str, rules: BusinessRules) -> Column:
    return bucket(business_time(F.col("record_time"), rules), unit)


def bucket_totals(traffic: Traffic, request: Request) -> DataFrame:
    """``(period_start, total_in)`` of each bucket of the request that has rows.

    For all stores no store is needed, so there is no join. For one store the
    rows are summed by store id first and only the sums are joined.
    """
    rows = business_days(traffic, request)
    period_start = business_bucket(request.unit, traffic.rules).alias("period_start")
    total_in = F.sum("in_count").alias("total_in")
    if request.store == ALL_STORES:
        return rows.groupBy(period_start).agg(total_in)
    by_store = prefilter_store(traffic, rows, request).groupBy("store_id", period_start)
    sums = by_store.agg(F.sum("in_count").alias("in_count"))
    return with_store_names(traffic, sums, request).groupBy("period_start").agg(total_in)


def trend(traffic: Traffic, request: Request) -> DataFrame:
    """The trend series ``(x, y)``: labelled buckets in order of time."""
    start = clock_time(F.col("period_start"), traffic.rules)
    return (
        bucket_totals(traffic, request)
        .orderBy("period_start")
        .select(label(start, request.unit).alias("x"), F.col("total_in").alias("y"))
    )


def hourly_rollup(counts: DataFrame) -> DataFrame:
    """Counts per store and hour, in the shape ``Traffic.from_rollup`` reads.

    Sums of rollups are rollups, so a load adds its own without rereading history.
    """
    return sum_hours(counts.withColumn("record_time", bucket(F.col("record_time"), "hour")))


def sum_hours(hours: DataFrame) -> DataFrame:
    """One row per store and hour of rows that may hold several."""
    return (
        hours.groupBy("store_id", "record_time")
        .agg(F.sum("in_count").alias("in_count"), F.sum("out_count").alias("out_count"))
        .select("record_time", "store_id", "in_count", "out_count")
        .withColumns({"year": F.year("record_time"), "month": F.month("record_time")})
    )
