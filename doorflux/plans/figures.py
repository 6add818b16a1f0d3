"""What a load leaves about itself: rows, times, bounds and distinct counts by month.

One small row per load and month, written once by the load. Bounds of a column tell
which loads and months can hold a value (zones); bounds, null counts and distinct-count
sketches of loads merge into those of the table without a look at its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.config import TableSpec
from doorflux.operators.quality import CONTRACTS, Contract, Field

#: Precision of the sketches: 2**14 registers, an error of 0.8 % of the distinct count.
SKETCH_BITS = 14
#: Ranges that the values of a batch are told apart by, when zones are looked up.
BINS = 1024
_NUMBERS = ("int", "bigint")


def _kept(contract: Contract) -> list[Field]:
    """Columns with figures; those made of others need none."""
    return [f for f in contract.fields if not f.derived]


def schema_of(contract: Contract) -> str:
    columns = ", ".join(
        f"{f.name}: struct<nulls: bigint, least: {f.type}, greatest: {f.type}, sketch: binary>" for f in _kept(contract)
    )
    return f"year int, month int, rows bigint, columns struct<{columns}>, load_id string"


def figures_of(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """The figures of the rows of one load, by month if the table is partitioned so."""
    contract = CONTRACTS[spec.dest_table]
    parts = [name for name in ("year", "month") if name in spec.partition_cols]
    columns = F.struct(*[
        F.struct(
            F.count_if(F.col(f.name).isNull()).alias("nulls"), F.min(f.name).alias("least"), F.max(f.name).alias("greatest"),
            F.hll_sketch_agg(F.col(f.name) if f.type in (*_NUMBERS, "string") else F.col(f.name).cast("string"), SKETCH_BITS).alias("sketch"),
        ).alias(f.name)
        for f in _kept(contract)
    ])
    found = rows.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), columns.alias("columns"))
    missing = {name: F.lit(None).cast("int") for name in ("year", "month") if name not in parts}
    return found.withColumns(missing).select("year", "month", "rows", "columns")


def statistics(figures: DataFrame, contract: Contract) -> DataFrame:
    """One row per column: rows, nulls, least and greatest value as text, distinct values.

    Counts and bounds are exact; distinct values are estimated from the merged sketches.
    """
    def text(name: str, found: Column) -> Column:
        return found.cast("string").alias(name)

    merged = figures.agg(F.sum("rows").alias("rows"), *[
        F.struct(
            F.sum(f"columns.{f.name}.nulls").alias("nulls"),
            text("least", F.min(f"columns.{f.name}.least")), text("greatest", F.max(f"columns.{f.name}.greatest")),
            F.hll_sketch_estimate(F.hll_union_agg(f"columns.{f.name}.sketch")).alias("distinct"),
        ).alias(f.name)
        for f in _kept(contract)
    ])
    entries = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce(f"{f.name}.nulls", F.lit(0)).alias("nulls"), F.col(f"{f.name}.least").alias("least"),
            F.col(f"{f.name}.greatest").alias("greatest"), F.coalesce(f"{f.name}.distinct", F.lit(0)).alias("distinct_count"),
        )
        for f in _kept(contract)
    ])
    return merged.select(F.inline(entries))


def bins_of(values: DataFrame, column: str) -> DataFrame:
    """The values of a column as at most ``BINS`` ranges ``(low, high)`` that are not empty."""
    known = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull())
    kind = known.schema["value"].dataType.simpleString()
    if kind in _NUMBERS:
        number = F.col("value").cast("double")
    elif kind == "timestamp_ntz":
        number = F.unix_micros(F.col("value").cast("timestamp")).cast("double")
    else:
        return known.agg(F.min("value").alias("low"), F.max("value").alias("high")).filter(F.col("low").isNotNull())
    numbered = known.select("value", number.alias("number"))
    ends = numbered.agg(F.min("number").alias("first"), F.max("number").alias("last")).first()
    if ends["first"] is None:
        return known.select(F.col("value").alias("low"), F.col("value").alias("high")).limit(0)
    width = max((ends["last"] - ends["first"]) / BINS, 1.0)
    place = F.least(F.floor((F.col("number") - F.lit(ends["first"])) / F.lit(width)), F.lit(BINS - 1))
    return numbered.groupBy(place.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high")).select("low", "high")


def overlapping(figures: DataFrame, column: str, ranges: DataFrame) -> list:
    """The zones ``(load_id, year, month)`` whose bounds of the column meet a range.

    ``ranges`` has at most ``BINS`` rows, so it is broadcast beside the zones; a null end is open.
    """
    zones = figures.select(
        "load_id", "year", "month",
        F.col(f"columns.{column}.least").alias("least"), F.col(f"columns.{column}.greatest").alias("greatest"),
    )
    meets = reduce(Column.__and__, [
        F.coalesce(F.col("least") <= F.col("high"), F.col("least").isNotNull()),
        F.coalesce(F.col("greatest") >= F.col("low"), F.col("greatest").isNotNull()),
    ])
    return zones.join(F.broadcast(ranges), meets, "left_semi").select("load_id", "year", "month").collect()
