"""Cleaning of raw source rows: clock, names, text, types, partition columns."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doorflux.config import DEFAULT_OFFSETS, TableSpec
from doorflux.functions import coercion

logger = logging.getLogger(__name__)

STORE_COLUMN = "storeid"
COUNT_COLUMNS = ("in_num", "out_num")

#: Carries the uncorrected source time to the high-water mark; never stored.
SOURCE_TIME = "_source_time"


def keep_source_time(df: DataFrame, spec: TableSpec) -> DataFrame:
    if spec.timestamp_col is None:
        return df
    return df.withColumn(SOURCE_TIME, coercion.timestamp(F.col(spec.timestamp_col)))


def correct_clock(
    df: DataFrame,
    spec: TableSpec,
    offsets: Mapping[str, Mapping[int, int]] = DEFAULT_OFFSETS,
) -> DataFrame:
    """Subtract each store's clock offset from the timestamp."""
    moment, by_store = spec.timestamp_col, offsets.get(spec.bare_source_name, {})
    needed = {STORE_COLUMN, moment}
    if moment and by_store and not needed <= set(df.columns):
        logger.warning("no clock correction of %s: %s missing", spec.source_table, needed - set(df.columns))
    if not moment or not by_store or not needed <= set(df.columns):
        return df
    late = coercion.minutes(coercion.offset_minutes(F.col(STORE_COLUMN), by_store))
    return df.withColumn(moment, coercion.timestamp(F.col(moment)) - late)


def rename_and_strip(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Warehouse names for the columns; cleaning rules applied to text columns."""
    df = df.withColumnsRenamed(dict(spec.rename_map))
    texts = [
        name
        for name in (spec.stored_name(rule.column) for rule in spec.cleaning_rules)
        if name in df.columns and isinstance(df.schema[name].dataType, T.StringType)
    ]
    if not texts:
        return df
    # Blanks, the padding of fixed-width texts, go first.
    trimmed = df.withColumns({name: F.trim(name) for name in texts})
    return trimmed.withColumns({name: coercion.strip_rest(F.col(name)) for name in texts})


def coerce_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """In and out counts as non-negative bigints, 0 where there is no number."""
    names = [spec.stored_name(source) for source in COUNT_COLUMNS if source in spec.rename_map]
    counts = {name: _count(df, name) for name in names if name in df.columns}
    return df.withColumns(counts) if counts else df


def _count(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return coercion.count_from_text(F.col(name))
    if isinstance(kind, T.IntegralType):
        return coercion.count_from_integer(F.col(name))
    return coercion.count_from_number(F.col(name))


def coerce_timestamp(df: DataFrame, spec: TableSpec) -> DataFrame:
    """A zone-less timestamp; rows without a valid one are dropped."""
    names = (spec.timestamp_col, spec.final_timestamp_col)
    name = next((name for name in names if name in df.columns), None)
    if name is None:
        return df
    return df.withColumn(name, coercion.timestamp(F.col(name))).filter(F.col(name).isNotNull())


def add_partition_columns(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Year and month of the corrected timestamp, as far as the spec asks."""
    name = spec.final_timestamp_col
    if name not in df.columns:
        return df
    parts = {"year": F.year(name), "month": F.month(name)}
    wanted = {part: parts[part] for part in spec.partition_cols if part in parts}
    return df.withColumns(wanted) if wanted else df


def clean(
    df: DataFrame,
    spec: TableSpec,
    offsets: Mapping[str, Mapping[int, int]] = DEFAULT_OFFSETS,
) -> DataFrame:
    """All cleaning steps; one projection after Catalyst.

    Unreadable times are dropped first, as no later step changes which they are:
    the filter then reaches the scan as it is, without the clock correction.
    """
    return (
        df.transform(coerce_timestamp, spec)
        .transform(correct_clock, spec, offsets)
        .transform(rename_and_strip, spec)
        .transform(coerce_counts, spec)
        .transform(add_partition_columns, spec)
    )
