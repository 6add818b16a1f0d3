"""The error log and the freshness of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorflux.config import DEFAULT_RULES


def error_logs(
    errors: DataFrame, stores: DataFrame, limit: int = DEFAULT_RULES.error_rows
) -> DataFrame:
    """The newest errors with store names; an unknown store has none.

    The newest are taken before the join (each has one store at most), so every
    task keeps ``limit`` rows and only the survivors look up a name. For a warehouse
    table hand in ``Warehouse.newest``, which names the months that are needed.
    """
    newest = (F.desc("logged_at"), F.asc("log_id"))
    picked = (
        errors.select("log_id", "store_id", "logged_at", "error_code", "error_message")
        .orderBy(*newest)
        .limit(limit)
    )
    return (
        picked.join(stores.select("store_id", "store_name"), "store_id", "left")
        .orderBy(*newest)
        .select(
            F.col("log_id").alias("id"),
            "store_name",
            F.col("logged_at").alias("log_time"),
            "error_code",
            "error_message",
        )
    )


def has_errors(errors: DataFrame) -> DataFrame:
    """One row: whether there is any error at all; the first one found is enough."""
    return errors.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_errors"))


def latest_record_time(fact: DataFrame) -> DataFrame:
    """One row: the newest record of all, NULL if there is none."""
    return fact.agg(F.max("recorded_at").cast("timestamp_ntz").alias("latest_record_time"))
