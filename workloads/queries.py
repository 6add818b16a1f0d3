"""Registered queries: each a Spark function and, where SQL can say it, its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorflux.config import ERRORS, STORES, TRAFFIC, BusinessRules, TableSpec
from doorflux.functions import periods
from doorflux.functions.periods import Request
from doorflux.operators import (
    buckets,
    clean,
    errors,
    filters,
    metrics,
    normalize,
    quality,
    report,
    stores,
)
from doorflux.operators.normalize import Traffic
from doorflux.plans.dashboard import dashboard
from doorflux.plans.load import load_table, prepare, run_etl, run_summary, source_keys
from doorflux.plans.warehouse import Warehouse
from doorflux.session import scratch_dir
from doorflux.sources import extract, project, query
from doorflux.streaming import stream_load
from doorflux.streaming.incremental import batch_figures, landing_stream
from workloads import fixtures as fx
from workloads import sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

EVENTS_MONTH = Request.of("month", "2024-01-05", "2024-01-19")
EVENTS_WEEK = Request.of("week", "2024-01-08", "2024-01-14")
EVENTS_DAY = Request.of("day", "2024-01-05", "2024-01-19")
EVENTS_STORE = Request.of("month", "2024-01-05", "2024-01-19", "Supplier#000000003")
ORDERS_YEAR = Request.of("year", "1997-01-01", "1997-12-31")
ORDERS_MONTH = Request.of("month", "1997-03-01", "1997-03-31")
ORDERS_ALL = Request.of("year", "1995-01-01", "2001-12-31")
NO_SUCH_STORE = Request.of("month", "2024-01-05", "2024-01-19", "no such store")

EVENTS = (fx.EVENTS_FACT, fx.SUPPLIER_STORES)
ORDERS = (fx.ORDERS_FACT, fx.NATION_STORES)
LINEITEM = (fx.LINEITEM_FACT, fx.SUPPLIER_STORES)

#: Where the two-batch loads cut the feed.
CUT = "2024-01-16 12:00:00"


def registered(name: str, oracle: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return add


def warehouse_for(spark: SparkSession, name: str) -> Warehouse:
    return Warehouse(spark, scratch_dir(spark, name))


# -- sources -------------------------------------------------------------------


@registered("scan_project", f"SELECT recordtime, in_num, out_num, position, storeid FROM ({fx.RAW_TRAFFIC})")
def scan_project(spark, sf_dir):
    raw = fx.raw_traffic(spark, sf_dir).withColumn("unmapped", F.lit(1))
    return project(raw, TRAFFIC)


@registered("scan_all", "SELECT * FROM supplier")
def scan_all(spark, sf_dir):
    everything = TableSpec("dbo.supplier", "supplier", incremental=False)
    return extract(fx.table(spark, sf_dir, "supplier"), everything)


@registered("incremental_scan", f"SELECT * FROM ({fx.RAW_TRAFFIC}) WHERE recordtime > TIMESTAMP '{CUT}'")
def incremental_scan(spark, sf_dir):
    return extract(fx.raw_traffic(spark, sf_dir), TRAFFIC, CUT)


@registered(
    "param_query",
    f"WITH {sql.filtered(*EVENTS, EVENTS_STORE)} SELECT store_name, count(*) AS n, "
    "CAST(SUM(in_count) AS BIGINT) AS total_in FROM d GROUP BY store_name",
)
def param_query(spark, sf_dir):
    normalize.register_view(fx.events_fact(spark, sf_dir), fx.supplier_stores(spark, sf_dir))
    window = filters.window_of(EVENTS_STORE, BusinessRules())
    return query(
        spark,
        f"""SELECT store_name, count(*) AS n, sum(in_count) AS total_in
            FROM {normalize.VIEW_NAME}
            WHERE record_time >= CAST(? AS TIMESTAMP_NTZ) AND record_time < CAST(? AS TIMESTAMP_NTZ)
              AND store_name = ? GROUP BY store_name""",
        [window.start, window.end, EVENTS_STORE.store],
    )


# -- cleaning ------------------------------------------------------------------


@registered(
    "time_offset",
    f"SELECT storeid, position, in_num, {sql.corrected('recordtime', 'storeid')} AS recordtime FROM ({fx.RAW_TRAFFIC})",
)
def time_offset(spark, sf_dir):
    corrected = clean.correct_clock(fx.raw_traffic(spark, sf_dir), TRAFFIC)
    return corrected.select("storeid", "position", "in_num", "recordtime")


@registered(
    "rename_strip",
    f"SELECT recordtime AS recorded_at, in_num AS visitors_in, out_num AS visitors_out, "
    f"{sql.stripped('position')} AS device_position, storeid AS store_id FROM ({fx.DIRTY_TRAFFIC})",
)
def rename_strip(spark, sf_dir):
    return clean.rename_and_strip(fx.dirty_traffic(spark, sf_dir), TRAFFIC)


@registered(
    "numeric_coerce_clamp",
    f"SELECT {sql.count_of_text('in_num')} AS visitors_in, {sql.count_of_text('out_num')} AS visitors_out, "
    f"storeid AS store_id FROM ({fx.DIRTY_TRAFFIC})",
)
def numeric_coerce_clamp(spark, sf_dir):
    renamed = clean.rename_and_strip(fx.dirty_traffic(spark, sf_dir), TRAFFIC)
    counts = clean.coerce_counts(renamed, TRAFFIC)
    return counts.select("visitors_in", "visitors_out", "store_id")


@registered(
    "timestamp_coerce_drop",
    "SELECT TRY_CAST(recordtime AS TIMESTAMP) AS recorded_at, storeid AS store_id "
    f"FROM ({fx.DIRTY_TRAFFIC}) WHERE TRY_CAST(recordtime AS TIMESTAMP) IS NOT NULL",
)
def timestamp_coerce_drop(spark, sf_dir):
    renamed = clean.rename_and_strip(fx.dirty_traffic(spark, sf_dir), TRAFFIC)
    return clean.coerce_timestamp(renamed, TRAFFIC).select("recorded_at", "store_id")


@registered(
    "partition_cols",
    f"""WITH c AS (SELECT {sql.corrected('recordtime', 'storeid')} AS recorded_at, storeid AS store_id
                   FROM ({fx.RAW_TRAFFIC}))
        SELECT recorded_at, store_id, CAST(year(recorded_at) AS INTEGER) AS year,
               CAST(month(recorded_at) AS INTEGER) AS month FROM c""",
)
def partition_cols(spark, sf_dir):
    cleaned = clean.clean(fx.raw_traffic(spark, sf_dir), TRAFFIC)
    return cleaned.select("recorded_at", "store_id", "year", "month")


CLEAN_TRAFFIC = f"""
SELECT recorded_at, visitors_in, visitors_out, device_position, store_id,
       CAST(year(recorded_at) AS INTEGER) AS year, CAST(month(recorded_at) AS INTEGER) AS month
FROM (SELECT {sql.corrected('TRY_CAST(recordtime AS TIMESTAMP)', 'TRY_CAST(storeid AS BIGINT)')} AS recorded_at,
             {sql.count_of_text('in_num')} AS visitors_in, {sql.count_of_text('out_num')} AS visitors_out,
             {sql.stripped('position')} AS device_position, storeid AS store_id
      FROM ({fx.DIRTY_TRAFFIC}) WHERE TRY_CAST(recordtime AS TIMESTAMP) IS NOT NULL)"""

CLEAN_ERRORS = f"""
SELECT log_id, store_id, device_code, logged_at, error_code, error_message,
       CAST(year(logged_at) AS INTEGER) AS year, CAST(month(logged_at) AS INTEGER) AS month
FROM (SELECT ID AS log_id, CAST(storeid AS BIGINT) AS store_id, CAST(DeviceCode AS INTEGER) AS device_code,
             {sql.corrected('LogTime', 'storeid')} AS logged_at, Errorcode AS error_code,
             {sql.stripped('ErrorMessage')} AS error_message
      FROM ({fx.DIRTY_ERRORS}) WHERE LogTime IS NOT NULL)"""

CLEAN_STORES = f"SELECT tid AS store_id, {sql.stripped('name')} AS store_name FROM ({fx.RAW_STORES})"

LOADED_TRAFFIC = f"""
SELECT recorded_at, CAST(in_num AS BIGINT) AS visitors_in, CAST(out_num AS BIGINT) AS visitors_out,
       {sql.stripped('position')} AS device_position, CAST(storeid AS BIGINT) AS store_id,
       CAST(year(recorded_at) AS INTEGER) AS year, CAST(month(recorded_at) AS INTEGER) AS month
FROM (SELECT *, {sql.corrected('recordtime', 'storeid')} AS recorded_at FROM ({fx.RAW_TRAFFIC}))"""


@registered("clean_traffic", CLEAN_TRAFFIC)
def clean_traffic(spark, sf_dir):
    return clean.clean(fx.dirty_traffic(spark, sf_dir), TRAFFIC)


@registered("clean_errors", CLEAN_ERRORS)
def clean_errors(spark, sf_dir):
    cleaned = clean.clean(fx.dirty_errors(spark, sf_dir), ERRORS)
    types = {"store_id": "bigint", "device_code": "int"}
    return cleaned.withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})


@registered("clean_stores", CLEAN_STORES)
def clean_stores(spark, sf_dir):
    return clean.clean(fx.raw_stores(spark, sf_dir), STORES)


# -- contracts -----------------------------------------------------------------

TRAFFIC_FAILURES = f"""
WITH c AS ({CLEAN_TRAFFIC})
SELECT recorded_at, device_position, 'store_id' AS "column",
       CASE WHEN store_id IS NULL THEN 'not_null' ELSE 'coerce:bigint' END AS "check",
       store_id AS failure_case
FROM c WHERE TRY_CAST(store_id AS BIGINT) IS NULL"""

ERROR_FAILURES = f"""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY log_id) AS copies FROM ({CLEAN_ERRORS}))
SELECT log_id, logged_at, 'log_id' AS "column", 'unique' AS "check",
       CAST(log_id AS VARCHAR) AS failure_case FROM c WHERE copies > 1
UNION ALL
SELECT log_id, logged_at, 'store_id', 'not_null', NULL FROM c WHERE store_id IS NULL"""


@registered(
    "validate_accept",
    f"""SELECT recorded_at, visitors_in, visitors_out, device_position,
               CAST(store_id AS BIGINT) AS store_id, year, month
        FROM ({CLEAN_TRAFFIC}) WHERE TRY_CAST(store_id AS BIGINT) IS NOT NULL""",
)
def validate_accept(spark, sf_dir):
    cleaned = clean.clean(fx.dirty_traffic(spark, sf_dir), TRAFFIC)
    return quality.accepted(quality.flag(cleaned, quality.contract_for(TRAFFIC)))


@registered("validate_reject", TRAFFIC_FAILURES)
def validate_reject(spark, sf_dir):
    cleaned = clean.clean(fx.dirty_traffic(spark, sf_dir), TRAFFIC)
    cases = quality.failure_cases(quality.flag(cleaned, quality.contract_for(TRAFFIC)))
    return cases.select("recorded_at", "device_position", "column", "check", "failure_case")


@registered("validate_reject_errors", ERROR_FAILURES)
def validate_reject_errors(spark, sf_dir):
    flagged = prepare(fx.dirty_errors(spark, sf_dir), ERRORS)
    cases = quality.failure_cases(flagged)
    return cases.select("log_id", "logged_at", "column", "check", "failure_case")


@registered(
    "duplicate_keys",
    "SELECT l_orderkey * 10 + l_linenumber AS log_id, count(*) AS copies "
    "FROM lineitem GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf_dir):
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("log_id")
    return quality.repeated_keys(fx.table(spark, sf_dir, "lineitem").select(key), "log_id")


# -- the normalised view -------------------------------------------------------


@registered(
    "outlier_cap",
    f"SELECT store_id, visitors_in, visitors_out, {sql.capped('visitors_in')} AS in_count, "
    f"{sql.capped('visitors_out')} AS out_count FROM ({fx.LINEITEM_FACT})",
)
def outlier_cap(spark, sf_dir):
    return fx.lineitem_fact(spark, sf_dir).select(
        "store_id",
        "visitors_in",
        "visitors_out",
        normalize.cap_outlier(F.col("visitors_in")).alias("in_count"),
        normalize.cap_outlier(F.col("visitors_out")).alias("out_count"),
    )


@registered(
    "outlier_cap_constant",
    f"SELECT store_id, visitors_in, {sql.capped('visitors_in', constant=True)} AS in_count FROM ({fx.EVENTS_FACT})",
)
def outlier_cap_constant(spark, sf_dir):
    rules = BusinessRules(outlier_scale_ratio=0.0)
    capped = normalize.cap_outlier(F.col("visitors_in"), rules).alias("in_count")
    return fx.events_fact(spark, sf_dir).select("store_id", "visitors_in", capped)


@registered(
    "business_day_shift",
    f"SELECT recorded_at, recorded_at - INTERVAL '9 hours' AS adjusted_time FROM ({fx.EVENTS_FACT})",
)
def business_day_shift(spark, sf_dir):
    shifted = normalize.business_time(F.col("recorded_at")).alias("adjusted_time")
    return fx.events_fact(spark, sf_dir).select("recorded_at", shifted)


@registered("traffic_normalized", f"WITH {sql.view(*EVENTS)} SELECT * FROM v")
def traffic_normalized(spark, sf_dir):
    return normalize.normalize(fx.events_fact(spark, sf_dir), fx.supplier_stores(spark, sf_dir))


@registered(
    "labels",
    "SELECT DISTINCT strftime(h, '%Y-%m-%d %H:00') AS hour, strftime(h, '%Y-%m-%d') AS day, "
    "strftime(h, '%Y-%m') AS month, strftime(h, '%H:%M') AS hour_of_day, "
    "strftime(h, '%d/%m') AS day_of_month, strftime(h, 'Tháng %m') AS month_name "
    "FROM (SELECT date_trunc('hour', ts) AS h FROM events)",
)
def labels(spark, sf_dir):
    hour = periods.bucket(F.col("ts"), "hour").alias("h")
    styles = ("hour", "day", "month", "hour_of_day", "day_of_month", "month_name")
    hours = fx.table(spark, sf_dir, "events").select(hour).distinct()
    return hours.select(*[periods.label(F.col("h"), style).alias(style) for style in styles]).distinct()


@registered("business_day_filter", f"WITH {sql.filtered(*EVENTS, EVENTS_MONTH)} SELECT record_time, in_count, out_count FROM d")
def business_day_filter(spark, sf_dir):
    rows = filters.business_days(fx.events_traffic(spark, sf_dir), EVENTS_MONTH)
    return rows.select("record_time", "in_count", "out_count")


@registered("store_filter", f"WITH {sql.view(*EVENTS)} SELECT * FROM v WHERE store_name = '{EVENTS_STORE.store}'")
def store_filter(spark, sf_dir):
    return filters.of_store(traffic_normalized(spark, sf_dir), EVENTS_STORE.store)


# -- figures -------------------------------------------------------------------


def _bucket_query(name, fixture, tables, request):
    oracle = f"WITH {sql.buckets(*tables, request)} SELECT period_start, total_in FROM b"

    @registered(name, oracle)
    def run(spark, sf_dir):
        return buckets.bucket_totals(fixture(spark, sf_dir), request)


_bucket_query("bucket_totals_hour", fx.events_traffic, EVENTS, EVENTS_DAY)
_bucket_query("bucket_totals_day", fx.events_traffic, EVENTS, EVENTS_MONTH)
_bucket_query("bucket_totals_month", fx.orders_traffic, ORDERS, ORDERS_YEAR)


def _trend_query(name, fixture, tables, request):
    oracle = f"WITH {sql.buckets(*tables, request)} SELECT {sql.bucket_label(request)} AS x, total_in AS y FROM b ORDER BY 1"

    @registered(name, oracle)
    def run(spark, sf_dir):
        return buckets.trend(fixture(spark, sf_dir), request)


_trend_query("trend_hour", fx.events_traffic, EVENTS, EVENTS_DAY)
_trend_query("trend_day", fx.events_traffic, EVENTS, EVENTS_MONTH)
_trend_query("trend_month", fx.orders_traffic, ORDERS, ORDERS_YEAR)
_trend_query("trend_month_lineitem", fx.lineitem_traffic, LINEITEM, ORDERS_ALL)
_trend_query("trend_store", fx.events_traffic, EVENTS, EVENTS_STORE)


def _kpi_oracle(tables, request: Request, column: str = "*") -> str:
    return f"""
WITH {sql.buckets(*tables, request)},
prev AS (SELECT CAST(coalesce(SUM(in_count), 0) AS BIGINT) AS prev_total FROM v WHERE {sql.in_range(request, earlier=True)}),
s AS (SELECT store_name, CAST(SUM(in_count) AS BIGINT) AS y FROM d GROUP BY store_name),
one AS (
  SELECT (SELECT CAST(SUM(in_count) AS BIGINT) FROM d) AS cur,
         (SELECT CAST(SUM(in_count) - SUM(out_count) AS BIGINT) FROM d) AS inside,
         (SELECT AVG(total_in) FROM b) AS mean,
         (SELECT {sql.peak_label(request)} FROM b ORDER BY total_in DESC, period_start LIMIT 1) AS peak,
         (SELECT split_part(store_name, ' (', 1) FROM s ORDER BY y DESC, store_name NULLS LAST LIMIT 1) AS busiest,
         prev_total FROM prev),
{sql.rounded('one', "(CAST(cur - prev_total AS DOUBLE) / nullif(prev_total, 0)) * 100.0::DOUBLE", 'change')},
k AS (
  SELECT coalesce(cur, 0) AS total_in, CAST(round_even(coalesce(mean, 0), 0) AS BIGINT) AS average_in,
         coalesce(peak, '--:--') AS peak_time, coalesce(inside, 0) AS current_occupancy,
         CASE WHEN cur IS NULL THEN 'N/A' ELSE busiest END AS busiest_store,
         CASE WHEN cur IS NULL THEN 0.0::DOUBLE WHEN prev_total > 0 THEN change
              WHEN cur > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS growth, prev_total
  FROM rounded)
SELECT {column} FROM k"""


ALL_FIGURES = "total_in, average_in, peak_time, current_occupancy, busiest_store, growth"


def _kpi_query(name, function, fixture, tables, request, column):
    @registered(name, _kpi_oracle(tables, request, column))
    def run(spark, sf_dir):
        return function(fixture(spark, sf_dir), request)


_kpi_query("kpi_all", metrics.metrics, fx.events_traffic, EVENTS, EVENTS_MONTH, ALL_FIGURES)
_kpi_query("kpi_all_week", metrics.metrics, fx.events_traffic, EVENTS, EVENTS_WEEK, ALL_FIGURES)
_kpi_query("kpi_all_year", metrics.metrics, fx.orders_traffic, ORDERS, ORDERS_YEAR, ALL_FIGURES)
_kpi_query("kpi_all_month", metrics.metrics, fx.orders_traffic, ORDERS, ORDERS_MONTH, ALL_FIGURES)
_kpi_query("kpi_all_store", metrics.metrics, fx.events_traffic, EVENTS, EVENTS_STORE, ALL_FIGURES)
_kpi_query("kpi_all_lineitem", metrics.metrics, fx.lineitem_traffic, LINEITEM, ORDERS_YEAR, ALL_FIGURES)
_kpi_query("kpi_empty", metrics.metrics, fx.events_traffic, EVENTS, NO_SUCH_STORE, ALL_FIGURES)
_kpi_query("kpi_total_in", metrics.total_in, fx.events_traffic, EVENTS, EVENTS_MONTH, "total_in")
_kpi_query("kpi_average_in", metrics.average_in, fx.events_traffic, EVENTS, EVENTS_MONTH, "average_in")
_kpi_query("kpi_peak_time", metrics.peak_time, fx.orders_traffic, ORDERS, ORDERS_YEAR, "peak_time")
_kpi_query("kpi_peak_time_day", metrics.peak_time, fx.events_traffic, EVENTS, EVENTS_DAY, "peak_time")
_kpi_query("kpi_occupancy", metrics.occupancy, fx.events_traffic, EVENTS, EVENTS_MONTH, "current_occupancy")
_kpi_query("kpi_busiest_store", metrics.busiest_store, fx.orders_traffic, ORDERS, ORDERS_YEAR, "busiest_store")
_kpi_query("prev_period_total", metrics.previous_total, fx.orders_traffic, ORDERS, ORDERS_MONTH, "prev_total")
_kpi_query("growth", metrics.growth, fx.orders_traffic, ORDERS, ORDERS_MONTH, "total_in, prev_total, growth")


STORE_TOTALS = "SELECT store_name AS x, CAST(SUM(in_count) AS BIGINT) AS y FROM d GROUP BY store_name"


@registered("store_comparison", f"WITH {sql.filtered(*EVENTS, EVENTS_MONTH)} {STORE_TOTALS}")
def store_comparison(spark, sf_dir):
    return stores.store_comparison(fx.events_traffic(spark, sf_dir), EVENTS_MONTH)


@registered(
    "store_share",
    f"""WITH {sql.filtered(*ORDERS, ORDERS_YEAR)}, t AS ({STORE_TOTALS}),
        w AS (SELECT *, CAST(y AS DOUBLE) * 100.0::DOUBLE / CAST(nullif(SUM(y) OVER (), 0) AS DOUBLE) AS pct FROM t),
        {sql.rounded('w', 'pct', 'share', ties='up')}
        SELECT x, y, coalesce(share, 0.0::DOUBLE) AS share_pct FROM rounded""",
)
def store_share(spark, sf_dir):
    return stores.store_share(fx.orders_traffic(spark, sf_dir), ORDERS_YEAR)


@registered("distinct_stores", f"SELECT DISTINCT store_name FROM ({fx.NATION_STORES}) ORDER BY store_name")
def distinct_stores(spark, sf_dir):
    return stores.store_names(fx.nation_stores(spark, sf_dir))


@registered("latest_record_time", "SELECT MAX(l_shipdate) AS latest_record_time FROM lineitem")
def latest_record_time(spark, sf_dir):
    return errors.latest_record_time(fx.lineitem_fact(spark, sf_dir))


ERROR_LOGS = f"""
SELECT a.log_id AS id, b.store_name, a.logged_at AS log_time, a.error_code, a.error_message
FROM ({fx.EVENTS_ERRORS}) a LEFT JOIN ({fx.SUPPLIER_STORES}) b ON a.store_id = b.store_id
ORDER BY a.logged_at DESC, a.log_id LIMIT 100"""


@registered("error_logs", ERROR_LOGS)
def error_logs(spark, sf_dir):
    return errors.error_logs(fx.events_errors(spark, sf_dir), fx.supplier_stores(spark, sf_dir))


GOOD_ERRORS = f"""
SELECT * EXCLUDE (copies) FROM (SELECT *, count(*) OVER (PARTITION BY log_id) AS copies FROM ({CLEAN_ERRORS}))
WHERE copies = 1 AND store_id IS NOT NULL"""


@registered(
    "error_logs_loaded",
    f"""SELECT a.log_id AS id, b.store_name, a.logged_at AS log_time, a.error_code, a.error_message
        FROM ({GOOD_ERRORS}) a LEFT JOIN ({fx.SUPPLIER_STORES}) b ON a.store_id = b.store_id
        ORDER BY a.logged_at DESC, a.log_id LIMIT 100""",
)
def error_logs_loaded(spark, sf_dir):
    """From a partitioned table only the newest months are read."""
    target = warehouse_for(spark, "errors")
    load_table(target, ERRORS, fx.dirty_errors(spark, sf_dir))
    return errors.error_logs(target.newest("fact_errors", 100), fx.supplier_stores(spark, sf_dir))


@registered("has_errors", f"SELECT count(*) > 0 AS has_errors FROM ({fx.EVENTS_ERRORS})")
def has_errors(spark, sf_dir):
    return errors.has_errors(fx.events_errors(spark, sf_dir))


# -- reports -------------------------------------------------------------------

REPORT_COLUMNS = "period, total_in, pct_change, proportion_pct, proportion_change"


@registered("report_lag", f"WITH {sql.report(*ORDERS, ORDERS_ALL)} SELECT period_start, total_in, previous_in FROM r")
def report_lag(spark, sf_dir):
    return report.with_previous(fx.orders_traffic(spark, sf_dir), ORDERS_ALL)


def _report_query(name, fixture, tables, request):
    oracle = f"WITH {sql.report(*tables, request)} SELECT {REPORT_COLUMNS} FROM r ORDER BY period_start DESC"

    @registered(name, oracle)
    def run(spark, sf_dir):
        return report.report(fixture(spark, sf_dir), request)


_report_query("report_table", fx.orders_traffic, ORDERS, ORDERS_ALL)
_report_query("report_table_day", fx.events_traffic, EVENTS, EVENTS_MONTH)
_report_query("report_table_hour", fx.events_traffic, EVENTS, EVENTS_DAY)
_report_query("report_table_store", fx.events_traffic, EVENTS, EVENTS_STORE)
_report_query("report_table_lineitem", fx.lineitem_traffic, LINEITEM, ORDERS_ALL)


@registered(
    "report_summary",
    f"""WITH {sql.report(*ORDERS, ORDERS_ALL)}
        SELECT CAST(coalesce(SUM(total_in), 0) AS BIGINT) AS total_sum,
               coalesce(AVG(total_in), 0.0::DOUBLE) AS average_in FROM r""",
)
def report_summary(spark, sf_dir):
    return report.report_summary(fx.orders_traffic(spark, sf_dir), ORDERS_ALL)


REPORT_CSV = f"""
WITH {sql.report(*ORDERS, ORDERS_ALL)}, {sql.rounded('r', 'proportion_pct', 'share', ties='up', digits=2)}
SELECT period AS "Ky bao cao", CAST(total_in AS VARCHAR) AS "Tong luot vao",
       printf('%.2f', share) AS "Ty trong (%)",
       regexp_replace(printf('%.1f', pct_change), '\\.0$', '') AS "Chenh lech (%)" FROM rounded"""


@registered("report_csv", REPORT_CSV)
def report_csv(spark, sf_dir):
    rows = report.report(fx.orders_traffic(spark, sf_dir), ORDERS_ALL)
    path = report.write_csv(rows, scratch_dir(spark, "report"), ORDERS_ALL)
    return spark.read.option("header", True).csv(path)


@registered(
    "period_presets",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders),
            p AS (SELECT unnest(['day', 'week', 'month', 'year', 'default']) AS period)
       SELECT period, CAST(as_of AS VARCHAR) AS as_of,
              CAST(CAST(CASE period WHEN 'week' THEN date_trunc('week', as_of)
                   WHEN 'month' THEN date_trunc('month', as_of) WHEN 'default' THEN date_trunc('month', as_of)
                   WHEN 'year' THEN date_trunc('year', as_of) ELSE as_of END AS DATE) AS VARCHAR) AS start_date,
              CAST(CAST(CASE period WHEN 'week' THEN date_trunc('week', as_of) + INTERVAL '6 days'
                   WHEN 'month' THEN last_day(as_of)
                   WHEN 'year' THEN date_trunc('year', as_of) + INTERVAL '1 year' - INTERVAL '1 day'
                   ELSE as_of END AS DATE) AS VARCHAR) AS end_date
       FROM d, p""",
)
def period_presets(spark, sf_dir):
    names = F.array(*[F.lit(name) for name in ("day", "week", "month", "year", "default")])
    dates = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("as_of"))
    rows = dates.distinct().select("as_of", F.explode(names).alias("period"))
    first, last = periods.preset_range(F.col("period"), F.col("as_of"))
    return rows.select(
        "period",
        F.col("as_of").cast("string").alias("as_of"),
        first.cast("string").alias("start_date"),
        last.cast("string").alias("end_date"),
    )


HOURLY = f"""
SELECT date_trunc('hour', recorded_at) AS record_time, store_id,
       CAST(SUM({sql.capped('visitors_in')}) AS BIGINT) AS in_count,
       CAST(SUM({sql.capped('visitors_out')}) AS BIGINT) AS out_count,
       CAST(year(min(recorded_at)) AS INTEGER) AS year, CAST(month(min(recorded_at)) AS INTEGER) AS month
FROM ({fx.EVENTS_FACT}) GROUP BY 1, 2"""


@registered("hourly_rollup", HOURLY)
def hourly_rollup(spark, sf_dir):
    return buckets.hourly_rollup(normalize.counts_of(fx.events_fact(spark, sf_dir)))


@registered(
    "trend_from_rollup",
    f"WITH {sql.buckets(*EVENTS, EVENTS_MONTH)} SELECT {sql.bucket_label(EVENTS_MONTH)} AS x, total_in AS y FROM b ORDER BY 1",
)
def trend_from_rollup(spark, sf_dir):
    path = scratch_dir(spark, "rollup")
    hourly_rollup(spark, sf_dir).write.partitionBy("year", "month").parquet(path)
    stored = Traffic.from_rollup(spark.read.parquet(path), fx.supplier_stores(spark, sf_dir))
    return buckets.trend(stored, EVENTS_MONTH)


def _sections_oracle(request: Request) -> str:
    return f"""
WITH {sql.report(*EVENTS, request)},
k AS ({_kpi_oracle(EVENTS, request, ALL_FIGURES)})
SELECT 'metrics' AS section, CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in ALL_FIGURES.split(', '))})) AS VARCHAR) AS body FROM k
UNION ALL SELECT 'trend_chart', CAST(to_json(struct_pack(x := {sql.bucket_label(request)}, y := total_in)) AS VARCHAR) FROM b
UNION ALL SELECT 'store_comparison_chart', CAST(to_json(struct_pack(x := x, y := y)) AS VARCHAR) FROM ({STORE_TOTALS})
UNION ALL SELECT 'table_data', CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in REPORT_COLUMNS.split(', '))})) AS VARCHAR) FROM r
UNION ALL SELECT 'table_summary', CAST(to_json(struct_pack(total_sum := CAST(SUM(total_in) AS BIGINT), average_in := AVG(total_in))) AS VARCHAR) FROM r
UNION ALL SELECT 'error_logs', CAST(to_json(struct_pack(id := id, store_name := store_name, log_time := CAST(log_time AS VARCHAR),
                 error_code := error_code, error_message := error_message)) AS VARCHAR) FROM ({ERROR_LOGS})
UNION ALL SELECT 'latest_record_time', CAST(to_json(struct_pack(latest_record_time := CAST(MAX(recorded_at) AS VARCHAR))) AS VARCHAR) FROM fact"""


def _dashboard_query(name, request):
    @registered(name, _sections_oracle(request))
    def run(spark, sf_dir):
        """The sections are written, and what they were made from is let go."""
        parts = dashboard(
            fx.events_traffic(spark, sf_dir),
            errors.latest_record_time(fx.events_fact(spark, sf_dir)),
            fx.events_errors(spark, sf_dir),
            request,
        )
        path = scratch_dir(spark, "dashboard")
        try:
            parts.sections().write.parquet(path)
        finally:
            parts.release()
        return spark.read.parquet(path)


_dashboard_query("dashboard_payload", EVENTS_MONTH)
_dashboard_query("dashboard_payload_store", EVENTS_STORE)


# -- loading and publishing ----------------------------------------------------


@registered("partitioned_roundtrip", LOADED_TRAFFIC)
def partitioned_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "partitioned")
    cleaned = clean.clean(fx.raw_traffic(spark, sf_dir), TRAFFIC)
    typed = quality.accepted(quality.flag(cleaned, quality.contract_for(TRAFFIC)))
    first_half = F.col("recorded_at") <= periods.ntz(CUT)
    for part in (typed.filter(first_half), typed.filter(~first_half)):
        part.write.mode("append").partitionBy(*TRAFFIC.partition_cols).parquet(path)
    return spark.read.parquet(path)


@registered("full_load_roundtrip", f"SELECT CAST(store_id AS BIGINT) AS store_id, store_name FROM ({CLEAN_STORES}) WHERE store_name IS NOT NULL")
def full_load_roundtrip(spark, sf_dir):
    target = warehouse_for(spark, "full-load")
    for _ in range(2):  # a second full load replaces the first
        load_table(target, STORES, fx.raw_stores(spark, sf_dir))
    return target.table("dim_stores")


@registered("publish_version", "SELECT s_suppkey AS store_id, upper(s_name) AS store_name FROM supplier")
def publish_version(spark, sf_dir):
    target = warehouse_for(spark, "publish")
    database = _new_database(spark, target)
    named = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tid"), F.col("s_name").alias("name"))
    for version in (named, named.withColumn("name", F.upper("name"))):
        load_table(target, STORES, version)
        target.publish_to_catalog(STORES, database)
    return _kept(spark, f"SELECT * FROM {database}.dim_stores", database)


def _kept(spark, statement: str, database: str) -> DataFrame:
    """The rows of a statement, after which its database is dropped."""
    path = scratch_dir(spark, "kept")
    spark.sql(statement).write.parquet(path)
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.read.parquet(path)


def _new_database(spark, target: Warehouse) -> str:
    database = f"doorflux_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{target.root}/catalog'")
    return database


def _loaded_sources(spark, sf_dir) -> dict[str, DataFrame]:
    return {
        STORES.source_table: fx.raw_stores(spark, sf_dir),
        TRAFFIC.source_table: fx.raw_traffic(spark, sf_dir),
        ERRORS.source_table: fx.dirty_errors(spark, sf_dir),
    }


KNOWN_STORES = f"SELECT store_id, store_name FROM ({CLEAN_STORES}) WHERE store_name IS NOT NULL"


@registered("catalog_after_etl", f"WITH {sql.view(LOADED_TRAFFIC, KNOWN_STORES)} SELECT * FROM v")
def catalog_after_etl(spark, sf_dir):
    """The view of normalised traffic, read by its name after a load of all tables."""
    target = warehouse_for(spark, "etl-catalog")
    database = _new_database(spark, target)
    run_etl(target, _loaded_sources(spark, sf_dir), database=database)
    return _kept(spark, f"SELECT * FROM {database}.{normalize.VIEW_NAME}", database)


@registered(
    "table_statistics",
    f"""SELECT column_name, CAST(distinct_count AS VARCHAR) AS distinct_count, CAST(null_count AS VARCHAR) AS null_count,
               CAST(max_len AS VARCHAR) AS max_len FROM (
          SELECT 'store_id' AS column_name, count(DISTINCT store_id) AS distinct_count, count(*) - count(store_id) AS null_count, 8 AS max_len FROM ({KNOWN_STORES})
          UNION ALL SELECT 'store_name', NULL, count(*) - count(store_name), max(strlen(store_name)) FROM ({KNOWN_STORES}))""",
)
def table_statistics(spark, sf_dir):
    """Column statistics that a full load leaves in the catalog (distinct ids are few enough to be exact)."""
    target = warehouse_for(spark, "statistics")
    database = _new_database(spark, target)
    load_table(target, STORES, fx.raw_stores(spark, sf_dir))
    target.publish_to_catalog(STORES, database)
    rows = []
    for column in ("store_id", "store_name"):
        found = {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE EXTENDED {database}.dim_stores_loads {column}").collect()}
        exact = found["distinct_count"] if column == "store_id" else None
        rows.append((column, exact, found["num_nulls"], found["max_col_len"] if column == "store_name" else "8"))
    spark.sql(f"DROP DATABASE {database} CASCADE")
    return spark.createDataFrame(rows, "column_name string, distinct_count string, null_count string, max_len string")


@registered("compacted_loads", LOADED_TRAFFIC)
def compacted_loads(spark, sf_dir):
    target = warehouse_for(spark, "compact")
    raw = fx.raw_traffic(spark, sf_dir)
    load_table(target, TRAFFIC, raw.filter(F.col("recordtime") <= periods.ntz(CUT)))
    load_table(target, TRAFFIC, raw)
    target.compact(TRAFFIC)
    return target.table("fact_traffic")


@registered(
    "publish_noop",
    "SELECT 1 AS run, true AS published, count(*) AS rows_loaded, 1 AS version FROM events "
    "UNION ALL SELECT 2, false, 0, 1",
)
def publish_noop(spark, sf_dir):
    target = warehouse_for(spark, "noop")
    raw = fx.raw_traffic(spark, sf_dir)
    runs = [(run, load_table(target, TRAFFIC, raw)) for run in (1, 2)]
    rows = [(run, done.published, done.load.rows, done.commit.version) for run, done in runs]
    return spark.createDataFrame(rows, "run int, published boolean, rows_loaded bigint, version int")


@registered(
    "run_metrics",
    f"""WITH errs AS (SELECT *, count(*) OVER (PARTITION BY log_id) AS copies FROM ({CLEAN_ERRORS}))
        SELECT 10 AS processing_order, 'dim_stores' AS dest_table, 'succeeded' AS status,
               count(*) FILTER (WHERE name IS NOT NULL) AS rows_loaded,
               count(*) FILTER (WHERE name IS NULL) AS rows_rejected, true AS published FROM ({fx.RAW_STORES})
        UNION ALL
        SELECT 20, 'fact_traffic', 'succeeded', count(*) FILTER (WHERE TRY_CAST(store_id AS BIGINT) IS NOT NULL),
               count(*) FILTER (WHERE TRY_CAST(store_id AS BIGINT) IS NULL), true FROM ({CLEAN_TRAFFIC})
        UNION ALL
        SELECT 20, 'fact_errors', 'succeeded', count(*) FILTER (WHERE copies = 1 AND store_id IS NOT NULL),
               count(*) FILTER (WHERE copies > 1 OR store_id IS NULL), true FROM errs""",
)
def run_metrics(spark, sf_dir):
    figures = run_etl(warehouse_for(spark, "etl"), _dirty_sources(spark, sf_dir))
    return figures.select(
        "processing_order", "dest_table", "status", "rows_loaded", "rows_rejected", "published"
    )


def _dirty_sources(spark, sf_dir) -> dict[str, DataFrame]:
    traffic = fx.dirty_traffic(spark, sf_dir)
    return {
        STORES.source_table: fx.raw_stores(spark, sf_dir),
        TRAFFIC.source_table: traffic.withColumn("recordtime", F.col("recordtime").try_cast("timestamp_ntz")),
        ERRORS.source_table: fx.dirty_errors(spark, sf_dir),
    }


@registered(
    "run_summary",
    f"""WITH t AS (SELECT count(*) > 0 AS good FROM ({CLEAN_STORES}) UNION ALL
                  SELECT count(*) > 0 FROM ({CLEAN_TRAFFIC}) UNION ALL SELECT false)
        SELECT count(*) AS total_tables, count(*) FILTER (WHERE good) AS succeeded,
               count(*) FILTER (WHERE NOT good) AS failed FROM t""",
)
def run_summary_query(spark, sf_dir):
    sources = _dirty_sources(spark, sf_dir)
    sources[ERRORS.source_table] = sources[ERRORS.source_table].drop("ID")
    return run_summary(run_etl(warehouse_for(spark, "etl-summary"), sources))


@registered(
    "dead_letters",
    f"""SELECT recorded_at, device_position, TRY_CAST(store_id AS BIGINT) AS store_id
        FROM ({CLEAN_TRAFFIC}) WHERE TRY_CAST(store_id AS BIGINT) IS NULL""",
)
def dead_letters(spark, sf_dir):
    target = warehouse_for(spark, "dead-letters")
    load_table(target, TRAFFIC, _dirty_sources(spark, sf_dir)[TRAFFIC.source_table])
    return target.rejected("fact_traffic").select("recorded_at", "device_position", "store_id")


@registered(
    "dead_letters_two_loads",
    f"""SELECT recorded_at, device_position, TRY_CAST(store_id AS BIGINT) AS store_id
        FROM ({CLEAN_TRAFFIC}) WHERE TRY_CAST(store_id AS BIGINT) IS NULL""",
)
def dead_letters_two_loads(spark, sf_dir):
    """First the bad rows alone, then all, then all again: each bad row is kept once."""
    target = warehouse_for(spark, "dead-letters-two")
    feed = _dirty_sources(spark, sf_dir)[TRAFFIC.source_table]
    half = feed.filter(F.col("recordtime") <= periods.ntz(CUT))
    load_table(target, TRAFFIC, half.filter(F.col("storeid").try_cast("bigint").isNull()))
    for rows in (feed.filter(F.col("storeid").try_cast("bigint").isNull()), feed, feed):
        load_table(target, TRAFFIC, rows)
    return target.rejected("fact_traffic").select("recorded_at", "device_position", "store_id")


@registered(
    "duplicate_across_loads",
    f"""WITH good AS ({GOOD_ERRORS})
        SELECT log_id, 'accepted' AS outcome FROM good
        UNION ALL SELECT log_id, 'unique' FROM good""",
)
def duplicate_across_loads(spark, sf_dir):
    """The same log ids come again with later times: the first rows stay, the others are set aside."""
    target = warehouse_for(spark, "duplicates")
    feed = fx.dirty_errors(spark, sf_dir)
    load_table(target, ERRORS, feed)
    good = target.table("fact_errors").select("log_id")
    again = feed.join(good, F.col("ID") == F.col("log_id"), "left_semi")
    load_table(target, ERRORS, again.withColumn("LogTime", F.col("LogTime") + periods.hours(24 * 500)))
    accepted = target.table("fact_errors").select("log_id", F.lit("accepted").alias("outcome"))
    last = F.array_contains(F.transform("failures", lambda x: x["check"]), "unique") & (F.year("logged_at") > 2024)
    rejected = target.rejected("fact_errors").filter(last)
    return accepted.unionAll(rejected.select("log_id", F.lit("unique").alias("outcome")))


@registered(
    "hwm_max",
    "SELECT 'fact_traffic' AS dest_table, MAX(ts) AS mark FROM events UNION ALL "
    f"SELECT 'fact_errors', MAX(LogTime) FROM ({fx.DIRTY_ERRORS}) WHERE LogTime IS NOT NULL",
)
def hwm_max(spark, sf_dir):
    feeds = ((TRAFFIC, fx.raw_traffic(spark, sf_dir)), (ERRORS, fx.dirty_errors(spark, sf_dir)))
    marks = [
        clean.keep_source_time(rows, spec).agg(F.max(clean.SOURCE_TIME).alias("mark")).select(
            F.lit(spec.dest_table).alias("dest_table"), "mark"
        )
        for spec, rows in feeds
    ]
    return marks[0].unionAll(marks[1])


@registered(
    "hwm_state",
    "SELECT 'fact_traffic' AS dest_table, MAX(ts) AS mark FROM events UNION ALL "
    "SELECT 'fact_errors', TIMESTAMP '1900-01-01 00:00:00'",
)
def hwm_state(spark, sf_dir):
    target = warehouse_for(spark, "state")
    load_table(target, TRAFFIC, fx.raw_traffic(spark, sf_dir))
    return target.marks([STORES, TRAFFIC, ERRORS])


@registered("incremental_two_batches", LOADED_TRAFFIC)
def incremental_two_batches(spark, sf_dir):
    target = warehouse_for(spark, "two-batches")
    raw = fx.raw_traffic(spark, sf_dir)
    load_table(target, TRAFFIC, raw.filter(F.col("recordtime") <= periods.ntz(CUT)))
    load_table(target, TRAFFIC, raw)
    return target.table("fact_traffic")


def _late_load(spark, sf_dir, lookback):
    """Purchases of the first batch's span reach the source only afterwards."""
    target = warehouse_for(spark, "late")
    raw = fx.raw_traffic(spark, sf_dir)
    on_time = (F.col("recordtime") <= periods.ntz(CUT)) & (F.trim("position") != "purchase")
    load_table(target, TRAFFIC, raw.filter(on_time))
    load_table(target, TRAFFIC, raw, lookback=lookback)
    return target.table("fact_traffic")


@registered(
    "late_rows",
    f"""SELECT * FROM ({LOADED_TRAFFIC}) l WHERE NOT (device_position = 'purchase'
        AND l.recorded_at + to_minutes({sql.offset_of('store_id')})
            <= (SELECT MAX(recordtime) FROM ({fx.RAW_TRAFFIC})
                WHERE recordtime <= TIMESTAMP '{CUT}' AND trim(position) <> 'purchase'))""",
)
def late_rows(spark, sf_dir):
    return _late_load(spark, sf_dir, None)


@registered("late_rows_lookback", LOADED_TRAFFIC)
def late_rows_lookback(spark, sf_dir):
    return _late_load(spark, sf_dir, "60 days")


@registered("stream_incremental", LOADED_TRAFFIC)
def stream_incremental(spark, sf_dir):
    target = warehouse_for(spark, "stream")
    events = landing_stream(target, sf_dir, fx.SCHEMAS["events"], "events.parquet")
    raw = events.select(
        F.col("ts").alias("recordtime"),
        F.floor("value").cast("int").alias("in_num"),
        F.get_json_object("props", "$.k").cast("int").alias("out_num"),
        F.rpad("event_type", 30, " ").alias("position"),
        F.col("user_id").cast("int").alias("storeid"),
    )
    checkpoint = scratch_dir(spark, "stream-checkpoint")
    for _ in range(2):  # the second run finds no new file
        stream_load(target, TRAFFIC, raw, checkpoint).awaitTermination()
    return target.table("fact_traffic")


@registered("late_rows_repeated", LOADED_TRAFFIC)
def late_rows_repeated(spark, sf_dir):
    """Late rows reach the source, and each of them comes twice."""
    target = warehouse_for(spark, "late-twice")
    raw = fx.raw_traffic(spark, sf_dir)
    keys = ["storeid", "position", "recordtime"]
    late = (F.col("recordtime") <= periods.ntz(CUT)) & (F.trim("position") == "purchase")
    load_table(target, TRAFFIC, raw.filter(~late))
    alone = raw.filter(late).groupBy(keys).count().filter("count = 1")
    twice = raw.filter(late).join(alone, keys, "left_semi").select(raw.columns)
    load_table(target, TRAFFIC, raw.unionAll(twice), lookback="60 days")
    return target.table("fact_traffic")


@registered("stream_two_sources", LOADED_TRAFFIC)
def stream_two_sources(spark, sf_dir):
    """Two streams, each with its checkpoint, load their halves into one table, twice."""
    target = warehouse_for(spark, "two-streams")
    raw = fx.raw_traffic(spark, sf_dir)
    early = F.col("recordtime") <= periods.ntz(CUT)
    for _ in range(2):
        for name, rows in (("a", raw.filter(early)), ("b", raw.filter(~early))):
            landing = f"{target.root}/landing-{name}"
            rows.write.mode("ignore").parquet(landing)
            stream = landing_stream(target, landing, fx.RAW_TRAFFIC_SCHEMA)
            stream_load(target, TRAFFIC, stream, f"{target.root}/checkpoint-{name}").awaitTermination()
        target.compact(TRAFFIC)
    return target.table("fact_traffic")


@registered(
    "latest_record_loaded",
    f"SELECT MAX(recorded_at) AS latest_record_time FROM ({LOADED_TRAFFIC})",
)
def latest_record_loaded(spark, sf_dir):
    """From the commits alone."""
    target = warehouse_for(spark, "latest")
    raw = fx.raw_traffic(spark, sf_dir)
    load_table(target, TRAFFIC, raw.filter(F.col("recordtime") <= periods.ntz(CUT)))
    load_table(target, TRAFFIC, raw)
    return target.latest_record_time()


@registered(
    "trend_from_warehouse_rules",
    f"""WITH {sql.buckets(LOADED_TRAFFIC, fx.SUPPLIER_STORES, EVENTS_MONTH, above=40)}
        SELECT {sql.bucket_label(EVENTS_MONTH)} AS x, total_in AS y FROM b ORDER BY 1""",
)
def trend_from_warehouse_rules(spark, sf_dir):
    """Other rules than the hourly sums were made with: the histograms of hours answer."""
    target = warehouse_for(spark, "rules-warehouse")
    load_table(target, TRAFFIC, fx.raw_traffic(spark, sf_dir))
    rules = BusinessRules(outlier_threshold=40)
    return buckets.trend(target.traffic(rules, hourly=True), EVENTS_MONTH)


@registered(
    "trend_from_warehouse",
    f"""WITH {sql.buckets(f"SELECT recorded_at, visitors_in, visitors_out, store_id FROM ({LOADED_TRAFFIC})", fx.SUPPLIER_STORES, EVENTS_MONTH)}
        SELECT {sql.bucket_label(EVENTS_MONTH)} AS x, total_in AS y FROM b ORDER BY 1""",
)
def trend_from_warehouse(spark, sf_dir):
    """Two loads, each adding its hourly sums; the trend reads only those."""
    target = warehouse_for(spark, "rollup-warehouse")
    raw = fx.raw_traffic(spark, sf_dir)
    load_table(target, TRAFFIC, raw.filter(F.col("recordtime") <= periods.ntz(CUT)))
    load_table(target, TRAFFIC, raw)
    return buckets.trend(target.traffic(hourly=True), EVENTS_MONTH)


@registered("trend_year_from_day_sums", f"WITH {sql.buckets(*ORDERS, ORDERS_ALL)} SELECT {sql.bucket_label(ORDERS_ALL)} AS x, total_in AS y FROM b ORDER BY 1")
def trend_year_from_day_sums(spark, sf_dir):
    """Seven years: business days give all but the last night, which comes from hours."""
    target = warehouse_for(spark, "day-sums")
    fact = fx.orders_fact(spark, sf_dir)
    feed = fact.select(
        F.col("recorded_at").alias("recordtime"), F.col("visitors_in").cast("int").alias("in_num"),
        F.col("visitors_out").cast("int").alias("out_num"), F.lit("door").alias("position"), F.col("store_id").cast("int").alias("storeid"),
    )
    load_table(target, TRAFFIC, feed, offsets={})
    return buckets.trend(target.traffic(hourly=True), ORDERS_ALL)


@registered(
    "kpi_all_store_loaded",
    _kpi_oracle((f"SELECT recorded_at, visitors_in, visitors_out, store_id FROM ({LOADED_TRAFFIC})", KNOWN_STORES), EVENTS_STORE, ALL_FIGURES),
)
def kpi_all_store_loaded(spark, sf_dir):
    """The files of a clustered load hold few stores each; the chosen store's ids reach the scan."""
    target = warehouse_for(spark, "clustered")
    load_table(target, STORES, fx.raw_stores(spark, sf_dir))
    load_table(target, TRAFFIC, fx.raw_traffic(spark, sf_dir), cluster=True)
    return metrics.metrics(target.traffic_of(EVENTS_STORE.store), EVENTS_STORE)


STATISTICS = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, count(*) AS rows, count(*) - count({name}) AS nulls, CAST(min({name}) AS VARCHAR) AS least, "
    f"CAST(max({name}) AS VARCHAR) AS greatest, true AS distinct_within_3_percent FROM ({LOADED_TRAFFIC})"
    for name in ("visitors_in", "visitors_out", "device_position", "store_id")
)


@registered("table_statistics_incremental", STATISTICS)
def table_statistics_incremental(spark, sf_dir):
    """Merged from what two loads left about themselves; no row of the table is read for it."""
    target = warehouse_for(spark, "incremental-statistics")
    raw = fx.raw_traffic(spark, sf_dir)
    load_table(target, TRAFFIC, raw.filter(F.col("recordtime") <= periods.ntz(CUT)))
    load_table(target, TRAFFIC, raw)
    names = ("visitors_in", "visitors_out", "device_position", "store_id")
    exact = target.table("fact_traffic").agg(*[F.count_distinct(name).alias(name) for name in names])
    exact = exact.unpivot([], list(names), "column_name", "distinct_values")
    near = F.abs(F.col("distinct_count") - F.col("distinct_values")) <= 0.03 * F.col("distinct_values")
    found = target.statistics("fact_traffic").join(exact, "column_name")
    return found.select("column_name", "rows", "nulls", "least", "greatest", near.alias("distinct_within_3_percent"))


ALONE = f"""SELECT * FROM ({fx.RAW_TRAFFIC})
            QUALIFY count(*) OVER (PARTITION BY recordtime, position, storeid) = 1"""


@registered(
    "stream_late_rows",
    LOADED_TRAFFIC.replace(f"({fx.RAW_TRAFFIC})", f"({ALONE})"),
)
def stream_late_rows(spark, sf_dir):
    """The second half lands first; then the first, days late and each row twice, with rows seen before;
    then all of it again, by a stream with a new checkpoint. Each row is loaded once."""
    target = warehouse_for(spark, "late-stream")
    raw = fx.raw_traffic(spark, sf_dir)
    keys = list(source_keys(TRAFFIC))
    raw = raw.join(raw.groupBy(keys).count().filter("count = 1"), keys, "left_semi").select(raw.columns)
    late = F.col("recordtime") <= periods.ntz(CUT)
    landings = (("a", raw.filter(~late)), ("a", raw.filter(late).unionAll(raw)), ("b", raw))
    for number, (checkpoint, rows) in enumerate(landings):
        rows.write.parquet(f"{target.root}/landing/{number}")
        stream = landing_stream(target, f"{target.root}/landing/*", fx.RAW_TRAFFIC_SCHEMA)
        stream_load(
            target, TRAFFIC, stream, f"{target.root}/checkpoint-{checkpoint}", distinct_on=keys, distinct_within="1 day"
        ).awaitTermination()
    return target.table("fact_traffic")


@registered(
    "stream_run_metrics",
    f"""WITH c AS (SELECT TRY_CAST(recordtime AS TIMESTAMP) <= TIMESTAMP '{CUT}' AS early, TRY_CAST(recordtime AS TIMESTAMP) AS recorded_at,
                          storeid FROM ({fx.DIRTY_TRAFFIC}))
        SELECT CASE WHEN early THEN 0 ELSE 1 END AS batch, count(*) AS arrived, count(TRY_CAST(storeid AS BIGINT)) AS rows,
               count(*) - count(TRY_CAST(storeid AS BIGINT)) AS rejected FROM c WHERE recorded_at IS NOT NULL GROUP BY 1""",
)
def stream_run_metrics(spark, sf_dir):
    """What arrived in each batch, from the stream's progress, and what became of it, from the loads."""
    target = warehouse_for(spark, "stream-figures")
    feed = fx.dirty_traffic(spark, sf_dir).filter(F.col("recordtime").try_cast("timestamp_ntz").isNotNull())
    early = F.col("recordtime").try_cast("timestamp_ntz") <= periods.ntz(CUT)
    with batch_figures(target, TRAFFIC) as figures:
        for name, rows in (("a", feed.filter(early)), ("b", feed.filter(~early))):
            rows.coalesce(1).write.parquet(f"{target.root}/landing/{name}")
            stream = landing_stream(target, f"{target.root}/landing/*", feed.schema.simpleString()[7:-1].replace(":", " "))
            stream = stream.withColumn("recordtime", F.col("recordtime").try_cast("timestamp_ntz"))
            query_ = stream_load(target, TRAFFIC, stream, f"{target.root}/checkpoint")
            query_.awaitTermination()
            figures.wait(query_)
    return target.stream_figures("fact_traffic").select("batch", "arrived", "rows", "rejected")
