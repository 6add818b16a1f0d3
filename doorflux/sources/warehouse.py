"""Parameterised SQL over registered warehouse tables and views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def query(
    spark: SparkSession, text: str, params: Sequence | Mapping | None = None
) -> DataFrame:
    """Run ``text`` with ``?`` (a sequence) or ``:name`` (a mapping) parameters."""
    if params is None:
        return spark.sql(text)
    args = dict(params) if isinstance(params, Mapping) else list(params)
    return spark.sql(text, args=args)
