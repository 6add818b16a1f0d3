"""Key figures of a request: total, average, peak, occupancy, busiest, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.functions import rounding
from doorflux.functions.periods import ALL_STORES, Request, label
from doorflux.functions.rounding import nearest_whole
from doorflux.operators.buckets import bucket_totals, business_bucket
from doorflux.operators.filters import (
    business_days,
    counts_in,
    prefilter_store,
    previous_window,
    window_of,
    with_store_names,
)
from doorflux.operators.normalize import Traffic, clock_time
from doorflux.operators.stores import store_totals

# What the figures show when no row matches.
NO_PEAK = "--:--"
NO_STORE = "N/A"


def total_in(traffic: Traffic, request: Request) -> DataFrame:
    sums = _sums(traffic, business_days(traffic, request), request, ins=F.col("in_count"))
    return sums.select(F.coalesce("ins", F.lit(0)).alias("total_in"))


def occupancy(traffic: Traffic, request: Request) -> DataFrame:
    """Visitors in minus visitors out; negative if more were seen leaving."""
    rows = business_days(traffic, request)
    sums = _sums(traffic, rows, request, ins=F.col("in_count"), outs=F.col("out_count"))
    inside = F.coalesce(F.col("ins") - F.col("outs"), F.lit(0))
    return sums.select(inside.alias("current_occupancy"))


def average_in(traffic: Traffic, request: Request) -> DataFrame:
    """The mean of the buckets that have rows, as a whole number."""
    mean = F.coalesce(F.avg("total_in"), F.lit(0.0))
    return bucket_totals(traffic, request).agg(nearest_whole(mean).alias("average_in"))


def peak_time(traffic: Traffic, request: Request) -> DataFrame:
    """The label of the bucket with most visitors; of equals, the earliest."""
    start = largest(F.col("period_start"), F.col("total_in"))
    peak = label(clock_time(start, traffic.rules), request.peak_label)
    return bucket_totals(traffic, request).agg(
        F.coalesce(peak, F.lit(NO_PEAK)).alias("peak_time")
    )


def busiest_store(traffic: Traffic, request: Request) -> DataFrame:
    """The store name with most visitors, without a `` (`` suffix."""
    totals = store_totals(traffic, request)
    return totals.agg(
        F.when(F.count(F.lit(1)) == 0, F.lit(NO_STORE))
        .otherwise(short_name(largest(F.col("x"), F.col("y"))))
        .alias("busiest_store")
    )


def previous_total(traffic: Traffic, request: Request) -> DataFrame:
    """Visitors of the same dates one period earlier; 0 if there were none."""
    window = previous_window(request, traffic.rules)
    rows = counts_in(traffic, [window], request.unit)
    sums = _sums(traffic, rows, request, ins=F.col("in_count"))
    return sums.select(F.coalesce("ins", F.lit(0)).alias("prev_total"))


def growth(traffic: Traffic, request: Request) -> DataFrame:
    """Both totals in one scan, and the change from the previous one."""
    now = window_of(request, traffic.rules)
    before = previous_window(request, traffic.rules)
    count = F.col("in_count")
    sums = _sums(
        traffic,
        counts_in(traffic, [now, before], request.unit),
        request,
        ins=_counted(count, now),
        ins_before=_counted(count, before),
    )
    figures = sums.select("ins", F.coalesce("ins_before", F.lit(0)).alias("prev_total"))
    return _with_growth(figures, "ins", "prev_total").select(
        F.coalesce("ins", F.lit(0)).alias("total_in"), "prev_total", "growth"
    )


def metrics(traffic: Traffic, request: Request) -> DataFrame:
    """All key figures as one row, from one scan of the counts.

    The scan covers both ranges and sums by (store id, bucket) before the first
    shuffle. All that follows works on these sums: naming the stores, one
    grouping-sets pass for the store, bucket and overall totals, and the row.
    """
    now = window_of(request, traffic.rules)
    before = previous_window(request, traffic.rules)
    rows = counts_in(traffic, [now, before], request.unit)
    rows = prefilter_store(traffic, rows, request)
    current = now.contains(F.col("record_time"))
    period_start = F.when(current, business_bucket(request.unit, traffic.rules))
    cells = rows.groupBy("store_id", period_start.alias("period_start")).agg(
        F.sum(F.when(current, F.col("in_count"))).alias("ins"),
        F.sum(F.when(current, F.col("out_count"))).alias("outs"),
        F.sum(_counted(F.col("in_count"), before)).alias("ins_before"),
    )
    named = with_store_names(traffic, cells, request)
    levels = named.groupingSets(
        [["store_name"], ["period_start"], []], "store_name", "period_start"
    ).agg(
        F.grouping_id().alias("level"),
        F.sum("ins").alias("ins"),
        F.sum("outs").alias("outs"),
        F.sum("ins_before").alias("ins_before"),
    )
    # grouping_id: bit 1 for a summed-up store name, bit 0 for a bucket.
    of_store, of_bucket, overall = (F.col("level") == value for value in (1, 2, 3))
    of_now = F.col("ins").isNotNull()
    summary = levels.agg(
        F.max(F.when(overall, F.col("ins"))).alias("total"),
        F.max(F.when(overall, F.col("outs"))).alias("total_out"),
        F.max(F.when(overall, F.col("ins_before"))).alias("total_before"),
        F.avg(F.when(of_bucket, F.col("ins"))).alias("mean"),
        largest(F.col("period_start"), F.col("ins"), of_bucket & of_now).alias("peak"),
        largest(F.col("store_name"), F.col("ins"), of_store & of_now).alias("busiest"),
    )
    summary = summary.fillna(0, subset=["total_before"])
    empty = F.col("total").isNull()
    peak = label(clock_time(F.col("peak"), traffic.rules), request.peak_label)
    return _with_growth(summary, "total", "total_before").select(
        F.coalesce("total", F.lit(0)).alias("total_in"),
        nearest_whole(F.coalesce("mean", F.lit(0.0))).alias("average_in"),
        F.coalesce(peak, F.lit(NO_PEAK)).alias("peak_time"),
        F.coalesce(F.col("total") - F.col("total_out"), F.lit(0)).alias("current_occupancy"),
        F.when(empty, F.lit(NO_STORE)).otherwise(short_name(F.col("busiest"))).alias("busiest_store"),
        "growth",
    )


def largest(value: Column, total: Column, where: Column | None = None) -> Column:
    """The value with the largest total; of equals the smallest, NULL last."""
    rank = F.struct(-total, value.isNull(), value)
    return F.min_by(value, rank if where is None else F.when(where, rank))


def short_name(name: Column) -> Column:
    return F.split_part(name, F.lit(" ("), F.lit(1))


def _counted(count: Column, window) -> Column:
    if window is None:
        return F.lit(None).cast("bigint")
    return F.when(window.contains(F.col("record_time")), count)


def _with_growth(figures: DataFrame, current: str, previous: str) -> DataFrame:
    now, before = F.col(current), F.col(previous)
    changed = figures.withColumn("change", rounding.percent_change(now, before))
    return changed.withColumn("growth", rounding.growth(now, before, F.col("change")))


def _sums(traffic: Traffic, rows: DataFrame, request: Request, **values: Column) -> DataFrame:
    """One row of sums, NULL where no row was counted."""
    if request.store != ALL_STORES:
        rows = prefilter_store(traffic, rows, request).groupBy("store_id").agg(
            *[F.sum(value).alias(name) for name, value in values.items()]
        )
        rows = with_store_names(traffic, rows, request)
        values = {name: F.col(name) for name in values}
    return rows.agg(*[F.sum(value).alias(name) for name, value in values.items()])
