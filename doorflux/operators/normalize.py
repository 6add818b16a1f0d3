"""The normalised view of traffic: outliers capped, stores named, days shifted."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import DEFAULT_RULES, BusinessRules
from doorflux.functions.periods import hours

VIEW_NAME = "v_traffic_normalized"


def cap_outlier(count: Column, rules: BusinessRules = DEFAULT_RULES) -> Column:
    """A count above the threshold is scaled down, or is 1 without a ratio."""
    if rules.outlier_scale_ratio > 0:
        scaled = F.round(count * F.lit(rules.outlier_scale_ratio), 0).cast("bigint")
    else:
        scaled = F.lit(1).cast("bigint")
    return F.when(count > rules.outlier_threshold, scaled).otherwise(count)


def business_time(moment: Column, rules: BusinessRules = DEFAULT_RULES) -> Column:
    """The moment shifted so that a business day starts at midnight."""
    return moment - hours(rules.working_hour_start)


def clock_time(moment: Column, rules: BusinessRules = DEFAULT_RULES) -> Column:
    """The inverse of ``business_time``, for showing bucket starts."""
    return moment + hours(rules.working_hour_start)


def counts_of(fact: DataFrame, rules: BusinessRules = DEFAULT_RULES) -> DataFrame:
    """Time, store id and capped counts of the fact table; no join.

    Partition columns are kept, for pruning.
    """
    kept = [name for name in ("year", "month") if name in fact.columns]
    return fact.select(
        F.col("recorded_at").cast("timestamp_ntz").alias("record_time"),
        "store_id",
        cap_outlier(F.col("visitors_in"), rules).alias("in_count"),
        cap_outlier(F.col("visitors_out"), rules).alias("out_count"),
        *kept,
    )


def normalize(
    fact: DataFrame, stores: DataFrame, rules: BusinessRules = DEFAULT_RULES
) -> DataFrame:
    """The view, row by row; traffic of an unknown store has no store name.

    The join carries no hint: Spark broadcasts the stores while their size is
    below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, with
    adaptive execution splitting the partition of a hot store. The dashboard
    queries do not use this join; they aggregate by store id first.
    """
    names = stores.select("store_id", "store_name")
    return (
        counts_of(fact, rules)
        .join(names, "store_id", "left")
        .select(
            "record_time",
            "store_name",
            "in_count",
            "out_count",
            business_time(F.col("record_time"), rules).alias("adjusted_time"),
        )
    )


def register_view(
    fact: DataFrame, stores: DataFrame, rules: BusinessRules = DEFAULT_RULES
) -> DataFrame:
    """Define or replace the session view ``v_traffic_normalized``."""
    view = normalize(fact, stores, rules)
    view.createOrReplaceTempView(VIEW_NAME)
    return view


@dataclass(frozen=True)
class Traffic:
    """What the dashboard queries read: counts by store id, and the stores.

    Counts may be single records or an hourly rollup. Sums are the same, because
    range ends and the business-day shift are whole hours. ``stores`` has one row
    per store id (the contract of the stores table). ``days``, if given, holds the same
    counts summed by business day, from the opening that ``rules`` name.
    """

    counts: DataFrame
    stores: DataFrame
    rules: BusinessRules = DEFAULT_RULES
    days: DataFrame | None = None

    @classmethod
    def from_fact(
        cls, fact: DataFrame, stores: DataFrame, rules: BusinessRules = DEFAULT_RULES
    ) -> Traffic:
        return cls(counts_of(fact, rules), stores.select("store_id", "store_name"), rules)

    @classmethod
    def from_rollup(
        cls, rollup: DataFrame, stores: DataFrame, rules: BusinessRules = DEFAULT_RULES,
        days: DataFrame | None = None,
    ) -> Traffic:
        return cls(rollup, stores.select("store_id", "store_name"), rules, days)

    def of_stores(self, store_ids: list[int]) -> Traffic:
        """The traffic of some stores; the ids reach the scans, which skip files without them."""
        chosen = F.col("store_id").isin(store_ids)
        days = None if self.days is None else self.days.filter(chosen)
        return replace(self, counts=self.counts.filter(chosen), days=days)
