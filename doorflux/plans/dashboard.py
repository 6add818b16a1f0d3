"""The whole dashboard of a request, as separate parts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorflux.functions.periods import Request
from doorflux.operators.buckets import hourly_rollup, trend
from doorflux.operators.errors import error_logs
from doorflux.operators.filters import counts_in, prefilter_store, previous_window, window_of
from doorflux.operators.metrics import metrics
from doorflux.operators.normalize import Traffic
from doorflux.operators.report import report, report_summary
from doorflux.operators.stores import store_comparison


@dataclass(frozen=True)
class Dashboard:
    """The parts of the dashboard; call ``release`` when they have been read."""

    metrics: DataFrame
    trend_chart: DataFrame
    store_comparison_chart: DataFrame
    table_data: DataFrame
    table_summary: DataFrame
    error_logs: DataFrame
    latest_record_time: DataFrame
    _hours: DataFrame

    def release(self) -> None:
        self._hours.unpersist()

    def sections(self) -> DataFrame:
        """One row ``(section, body)`` per entry, the body as JSON.

        No part is gathered in one place, however many stores there are.
        """
        parts = {
            "metrics": self.metrics,
            "trend_chart": self.trend_chart,
            "store_comparison_chart": self.store_comparison_chart,
            "table_data": self.table_data,
            "table_summary": self.table_summary,
            "error_logs": self.error_logs.withColumn("log_time", _iso("log_time")),
            "latest_record_time": self.latest_record_time.select(
                _iso("latest_record_time").alias("latest_record_time")
            ),
        }
        rows = [
            part.select(
                F.lit(name).alias("section"),
                F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"),
            )
            for name, part in parts.items()
        ]
        return reduce(DataFrame.unionAll, rows)


def dashboard(
    traffic: Traffic, latest: DataFrame, errors: DataFrame, request: Request
) -> Dashboard:
    """All parts of one request; ``latest`` is one row of the newest time.

    The counts of both ranges and of the chosen store are summed to store and hour
    once and kept, since five parts read them; hours answer each of them exactly, and so
    do business days if the traffic has their sums and no part shows hours.
    """
    rules = traffic.rules
    rows = counts_in(traffic, [window_of(request, rules), previous_window(request, rules)], request.unit)
    hours = hourly_rollup(prefilter_store(traffic, rows, request)).persist()
    hourly = Traffic.from_rollup(hours, traffic.stores, rules)
    return Dashboard(
        metrics=metrics(hourly, request),
        trend_chart=trend(hourly, request),
        store_comparison_chart=store_comparison(hourly, request),
        table_data=report(hourly, request),
        table_summary=report_summary(hourly, request),
        error_logs=error_logs(errors, traffic.stores, rules.error_rows),
        latest_record_time=latest,
        _hours=hours,
    )


def _iso(name: str) -> Column:
    return F.col(name).cast("string")
