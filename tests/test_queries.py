"""Query operators on small tables with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from doorflux import BusinessRules, Request, Traffic
from doorflux.operators import buckets, errors, filters, metrics, normalize, report, stores
from doorflux.plans.dashboard import dashboard
from tests.conftest import rows
from workloads import fixtures as fx
from workloads.queries import EVENTS_DAY, EVENTS_MONTH, EVENTS_STORE, EVENTS_WEEK, ORDERS_ALL

FACT = "recorded_at timestamp_ntz, visitors_in bigint, visitors_out bigint, store_id bigint"
STORES = "store_id bigint, store_name string"
DAY = Request.of("day", "2024-01-05", "2024-01-05")


def traffic(spark, records, named=((1, "one"), (2, "two")), rules=BusinessRules()):
    fact = [(datetime.fromisoformat(at), ins, outs, store) for at, ins, outs, store in records]
    return Traffic.from_fact(
        spark.createDataFrame(fact, FACT), spark.createDataFrame(list(named), STORES), rules
    )


def one(df):
    return tuple(df.first())


def test_range_ends(spark):
    edges = ["2024-01-05 08:59:59", "2024-01-05 09:00:00", "2024-01-06 01:59:59", "2024-01-06 02:00:00"]
    found = filters.business_days(traffic(spark, [(at, 1, 0, 1) for at in edges]), DAY)
    assert [str(row.record_time) for row in found.orderBy("record_time").collect()] == edges[1:3]


def test_night_hours_of_inner_days_stay(spark):
    request = Request.of("day", "2024-01-05", "2024-01-06")
    found = filters.business_days(traffic(spark, [("2024-01-06 04:00:00", 1, 0, 1)]), request)
    assert found.count() == 1


def test_outlier_cap(spark):
    df = spark.createDataFrame([(v,) for v in (100, 101, 49999, 50000, 150000, 250000)], "v bigint")
    assert [r[0] for r in df.select(normalize.cap_outlier(F.col("v"))).collect()] == [100, 0, 0, 1, 2, 3]
    constant = BusinessRules(outlier_scale_ratio=0)
    assert [r[0] for r in df.select(normalize.cap_outlier(F.col("v"), constant)).collect()] == [100, 1, 1, 1, 1, 1]


def test_unknown_store_keeps_its_traffic(spark):
    t = traffic(spark, [("2024-01-05 10:00:00", 9, 1, 7), ("2024-01-05 10:00:00", 4, 0, 1)])
    assert rows(stores.store_comparison(t, DAY)) == [("one", 4), (None, 9)]
    assert one(metrics.metrics(t, DAY))[4] is None
    assert one(metrics.busiest_store(t, DAY)) == (None,)


def test_ties(spark):
    t = traffic(spark, [
        ("2024-01-05 12:00:00", 5, 0, 2), ("2024-01-05 10:00:00", 5, 0, 1), ("2024-01-05 11:00:00", 5, 0, 7),
    ])
    assert one(metrics.metrics(t, DAY)) == (15, 5, "10:00", 15, "one", 100.0)
    assert one(metrics.peak_time(t, DAY)) == ("10:00",)
    assert one(metrics.busiest_store(t, DAY)) == ("one",)


def test_no_rows(spark):
    t = traffic(spark, [("2024-01-04 12:00:00", 5, 0, 1)])
    assert one(metrics.metrics(t, DAY)) == (0, 0, "--:--", 0, "N/A", 0.0)
    assert one(metrics.growth(t, DAY)) == (0, 5, 0.0)
    assert one(metrics.average_in(t, DAY)) == (0,)
    assert one(metrics.peak_time(t, DAY)) == ("--:--",)
    assert one(metrics.busiest_store(t, DAY)) == ("N/A",)
    assert one(report.report_summary(t, DAY)) == (0, 0.0)
    assert report.report(t, DAY).count() == 0
    assert buckets.trend(t, DAY).count() == 0


def test_rows_without_visitors_count_as_buckets(spark):
    t = traffic(spark, [("2024-01-05 12:00:00", 0, 3, 1), ("2024-01-04 12:00:00", 4, 0, 1)])
    assert one(metrics.metrics(t, DAY)) == (0, 0, "12:00", -3, "one", -100.0)


def test_overlapping_growth_windows(spark):
    request = Request.of("day", "2024-01-05", "2024-01-06")
    t = traffic(spark, [("2024-01-04 12:00:00", 2, 0, 1), ("2024-01-05 12:00:00", 4, 0, 1), ("2024-01-06 12:00:00", 6, 0, 2)])
    assert one(metrics.growth(t, request)) == (10, 6, 66.7)
    assert one(metrics.metrics(t, request))[5] == 66.7


def test_unknown_period_has_no_previous(spark):
    request = Request.of("quarter", "2024-01-05", "2024-01-06")
    t = traffic(spark, [("2024-01-04 12:00:00", 2, 0, 1), ("2024-01-05 12:00:00", 4, 0, 1)])
    assert one(metrics.previous_total(t, request)) == (0,)
    assert one(metrics.metrics(t, request)) == (4, 4, "05/01", 4, "one", 100.0)


def test_store_name_held_by_two_ids(spark):
    t = traffic(
        spark,
        [("2024-01-05 12:00:00", 2, 0, 1), ("2024-01-05 12:30:00", 3, 1, 2), ("2024-01-05 12:30:00", 4, 1, 3)],
        named=((1, "twin"), (2, "twin"), (3, "other")),
    )
    request = Request.of("day", "2024-01-05", "2024-01-05", "twin")
    assert rows(stores.store_comparison(t, DAY)) == [("other", 4), ("twin", 5)]
    assert one(metrics.metrics(t, request)) == (5, 5, "12:00", 4, "twin", 100.0)
    assert rows(buckets.trend(t, request)) == [("2024-01-05 12:00", 5)]


def test_business_name_is_cut_at_the_bracket(spark):
    t = traffic(spark, [("2024-01-05 12:00:00", 2, 0, 1)], named=((1, "Mall (north) (2)"),))
    assert one(metrics.busiest_store(t, DAY)) == ("Mall",)


def test_report_needs_the_bucket_before_the_oldest_shown(spark):
    days = [(f"2024-01-{day:02d} 12:00:00", day, 0, 1) for day in range(1, 6)]
    t = traffic(spark, days, rules=BusinessRules(report_rows=2))
    found = report.report(t, Request.of("month", "2024-01-01", "2024-01-31")).collect()
    assert [tuple(row)[:3] for row in found] == [("2024-01-05", 5, 25.0), ("2024-01-04", 4, 33.3)]
    assert found[0].proportion_pct == 5 / 9 * 100
    assert found[0].proportion_change == 5 / 9 * 100 - 4 / 9 * 100
    assert found[1].proportion_change == 0.0


def test_report_of_nothing_but_zeros(spark):
    t = traffic(spark, [("2024-01-05 12:00:00", 0, 0, 1), ("2024-01-05 13:00:00", 0, 0, 1)])
    assert rows(report.report(t, DAY)) == [
        ("2024-01-05 12:00", 0, 0.0, 0.0, 0.0), ("2024-01-05 13:00", 0, 0.0, 0.0, 0.0),
    ]
    assert rows(stores.store_share(t, DAY)) == [("one", 0, 0.0)]


def test_csv_file(spark, tmp_path):
    t = traffic(spark, [("2024-01-05 12:00:00", 1, 0, 1), ("2024-01-05 13:00:00", 2, 0, 1), ("2024-01-05 14:00:00", 3, 0, 1)])
    path = report.write_csv(report.report(t, DAY), str(tmp_path), DAY)
    assert path.endswith("bao_cao_day_2024-01-05_2024-01-05.csv")
    [part] = [p for p in (tmp_path / "bao_cao_day_2024-01-05_2024-01-05.csv").iterdir() if p.suffix == ".csv"]
    assert part.read_bytes().decode("utf-8").split("\n")[:4] == [
        "﻿Ky bao cao,Tong luot vao,Ty trong (%),Chenh lech (%)",
        "2024-01-05 14:00,3,50.00,50", "2024-01-05 13:00,2,33.33,100", "2024-01-05 12:00,1,16.67,0",
    ]


def test_error_logs_keep_unknown_stores_and_limit(spark):
    log = [(i, i % 2 + 1, datetime(2024, 1, 1, i // 2), 5, "m") for i in range(10)]
    df = spark.createDataFrame(log, "log_id bigint, store_id bigint, logged_at timestamp_ntz, error_code int, error_message string")
    named = spark.createDataFrame([(1, "one")], STORES)
    found = errors.error_logs(df, named, limit=3).collect()
    assert [(row.id, row.store_name) for row in found] == [(8, "one"), (9, None), (6, "one")]
    assert one(errors.has_errors(df)) == (True,)
    assert one(errors.has_errors(df.filter("log_id > 99"))) == (False,)
    assert one(errors.latest_record_time(spark.createDataFrame([], FACT))) == (None,)


@pytest.mark.parametrize("request_", [EVENTS_MONTH, EVENTS_WEEK, EVENTS_DAY, EVENTS_STORE])
def test_rollup_answers_as_records_do(spark, sf_dir, request_):
    records = fx.events_traffic(spark, sf_dir)
    rollup = Traffic.from_rollup(buckets.hourly_rollup(records.counts), records.stores)
    for function in (metrics.metrics, metrics.growth, buckets.trend, stores.store_comparison, report.report, report.report_summary):
        assert rows(function(records, request_)) == rows(function(rollup, request_))


@pytest.mark.parametrize("request_", [EVENTS_MONTH, EVENTS_DAY, EVENTS_STORE])
def test_single_figures_agree_with_the_row_of_all(spark, sf_dir, request_):
    t = fx.events_traffic(spark, sf_dir)
    every = metrics.metrics(t, request_).first().asDict()
    for function in (metrics.total_in, metrics.average_in, metrics.peak_time, metrics.occupancy, metrics.busiest_store):
        [(name, value)] = function(t, request_).first().asDict().items()
        assert every[name] == value
    assert every["growth"] == metrics.growth(t, request_).first().growth


@pytest.mark.parametrize("request_", [ORDERS_ALL, EVENTS_STORE])
def test_dashboard_parts(spark, sf_dir, request_):
    fixture, fact = (fx.orders_traffic, fx.orders_fact) if request_ is ORDERS_ALL else (fx.events_traffic, fx.events_fact)
    t = fixture(spark, sf_dir)
    latest = errors.latest_record_time(fact(spark, sf_dir))
    spark.catalog.clearCache()
    board = dashboard(t, latest, fx.events_errors(spark, sf_dir), request_)
    assert board.metrics.first() == metrics.metrics(t, request_).first()
    assert board.trend_chart.collect() == buckets.trend(t, request_).collect()
    assert board.store_comparison_chart.collect() == stores.store_comparison(t, request_).collect()
    assert board.table_data.collect() == report.report(t, request_).collect()
    assert board.table_summary.first() == report.report_summary(t, request_).first()
    assert board.sections().select("section").distinct().count() == 7
    board.release()
    assert not spark.sparkContext._jsc.sc().getPersistentRDDs().size()
