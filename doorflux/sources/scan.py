"""Source scans: column pruning and the high-water-mark filter.

Both are plain ``select`` and ``filter`` calls, so Catalyst hands them to the
Parquet reader or, for JDBC, to the database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorflux.config import TableSpec
from doorflux.functions.periods import interval, ntz


def parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    split_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    splits: int = 1,
    **options: str,
) -> DataFrame:
    """A database table. ``split_column`` with bounds reads it in parallel ranges."""
    return spark.read.format("jdbc").options(
        **jdbc_options(url, table, split_column, lower, upper, splits), **options
    ).load()


def jdbc_options(
    url: str,
    table: str,
    split_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    splits: int = 1,
) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "preferTimestampNTZ": "true"}
    if split_column is not None:
        if lower is None or upper is None:
            raise ValueError("a split column needs a lower and an upper bound")
        options.update(
            partitionColumn=split_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(splits),
        )
    return options


def project(source: DataFrame, spec: TableSpec) -> DataFrame:
    """The columns the spec maps, plus its timestamp; all if it maps none."""
    return source.select(*(spec.source_columns or ["*"]))


def extract(
    source: DataFrame,
    spec: TableSpec,
    mark: str | None = None,
    lookback: str | None = None,
) -> DataFrame:
    """The rows to load: all, or those strictly newer than the mark.

    ``lookback`` is an interval such as ``'3 days'``; rows up to that much older
    than the mark are read again, so that late ones are found.
    """
    rows = project(source, spec)
    if not spec.incremental or mark is None:
        return rows
    newest_known = ntz(mark)
    if lookback is not None:
        newest_known = newest_known - interval(lookback)
    return rows.filter(F.col(spec.timestamp_col) > newest_known)
