"""Traffic sums at three grains, written together by each load.

``value``: how many records of a store and hour had each pair of values. Any outlier rule
caps a record by its values alone, so these sparse histograms answer every rule exactly.
``hour`` and ``day``: capped sums of a store's hour and business day, under the rules of
the load. A business day reaches from opening to opening, and bears the time of its opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import DEFAULT_RULES, BusinessRules
from doorflux.functions.periods import bucket
from doorflux.operators.normalize import business_time, cap_outlier, clock_time

#: The columns of sums, and those of histograms beside them.
SUMS = ("record_time", "store_id", "in_count", "out_count", "year", "month")
CELLS = ("visitors_in", "visitors_out", "records")
_KEYS = ("grain", "store_id", "record_time", "visitors_in", "visitors_out")


def grains_of_records(fact: DataFrame, rules: BusinessRules = DEFAULT_RULES) -> DataFrame:
    """All three grains of a fact table, from one scan and one shuffle."""
    hour = bucket(F.col("recorded_at").cast("timestamp_ntz"), "hour").alias("record_time")
    return grains_of_values(fact.select("store_id", hour, "visitors_in", "visitors_out", F.lit(1).alias("records")), rules)


def grains_of_values(values: DataFrame, rules: BusinessRules = DEFAULT_RULES) -> DataFrame:
    """The same from stored histograms, of which several may be of one store and hour.

    Each row counts into a value, an hour and a day; what is equal is added up before
    anything moves.
    """
    time, none = F.col("record_time"), F.lit(None).cast("bigint")
    sums = [total.alias(name) for name, total in _capped(rules).items()]
    cells = [F.col("visitors_in"), F.col("visitors_out"), F.col("records").cast("bigint").alias("records")]
    no_cells = [none.alias(name) for name in CELLS]
    opening = clock_time(bucket(business_time(time, rules), "day"), rules)
    rows = values.select("store_id", F.inline(F.array(
        F.struct(F.lit("value").alias("grain"), time, *cells, none.alias("in_count"), none.alias("out_count")),
        F.struct(F.lit("hour").alias("grain"), time, *no_cells, *sums),
        F.struct(F.lit("day").alias("grain"), opening.alias("record_time"), *no_cells, *sums),
    )))
    added = rows.groupBy(*_KEYS).agg(*[F.sum(name).alias(name) for name in ("records", "in_count", "out_count")])
    return added.withColumns({"year": F.year("record_time"), "month": F.month("record_time")}).select("grain", *SUMS, *CELLS)


def capped_sums(values: DataFrame, rules: BusinessRules) -> DataFrame:
    """Hourly counts under any rules; a row for each pair of values, to be summed with all else."""
    return values.withColumns(_capped(rules)).select(*SUMS)


def _capped(rules: BusinessRules) -> dict[str, Column]:
    records = F.col("records")
    return {
        "in_count": cap_outlier(F.col("visitors_in"), rules) * records,
        "out_count": cap_outlier(F.col("visitors_out"), rules) * records,
    }
