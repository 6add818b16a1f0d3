"""Cleaning, contracts, incremental loads and publishing."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from doorflux.config import (
    BusinessRules,
    ERRORS,
    STORES,
    TRAFFIC,
    CleaningRule,
    TableSpec,
    default_specs,
    in_load_order,
    load_offsets,
    load_specs,
)
from doorflux.functions.periods import interval
from doorflux.operators import buckets, clean, quality
from doorflux.plans.load import load_table, prepare, run_etl, run_summary
from doorflux.sources import extract, jdbc_table, project, query
from doorflux.sources.scan import jdbc_options
from tests.conftest import plan_text, rows
from workloads import fixtures as fx
from workloads.queries import CUT, EVENTS_MONTH

RAW = "recordtime timestamp_ntz, in_num int, out_num int, position string, storeid int"
RAW_ERRORS = "ID bigint, storeid int, DeviceCode smallint, LogTime timestamp_ntz, Errorcode int, ErrorMessage string"


def raw(spark, *records):
    return spark.createDataFrame([(datetime.fromisoformat(at), i, 0, "door", s) for at, i, s in records], RAW)


def counted(warehouse):
    return [(str(at), ins, store) for at, ins, _, _, store, _, _ in rows(warehouse.table("fact_traffic"))]


# -- specs ---------------------------------------------------------------------


def test_specs():
    with pytest.raises(ValueError, match="timestamp_col"):
        TableSpec("dbo.t", "t")
    with pytest.raises(ValueError, match="cleaning action"):
        CleaningRule("c", "upper")
    spec = TableSpec.from_mapping({
        "source_table": "dbo.t", "dest_table": "d", "timestamp_col": "at", "partition_cols": ["year"],
        "rename_map": {"at": "time"}, "cleaning_rules": [{"column": "c", "action": "strip"}],
    })
    assert (spec.bare_source_name, spec.final_timestamp_col) == ("t", "time")
    assert spec.cleaning_rules == (CleaningRule("c"),)
    assert in_load_order(reversed(default_specs()))[0] is STORES


def test_specs_and_offsets_from_files(tmp_path):
    (tmp_path / "t.yaml").write_text("t:\n  source_table: dbo.t\n  dest_table: d\n  incremental: false\n")
    (tmp_path / "o.json").write_text('{"num_crowd": {"28": 53}}')
    (tmp_path / "empty.yaml").write_text("")
    [spec] = load_specs(str(tmp_path / "t.yaml"))
    assert (spec.dest_table, spec.incremental) == ("d", False)
    assert load_offsets(str(tmp_path / "o.json")) == {"num_crowd": {28: 53}}
    with pytest.raises(ValueError, match="empty"):
        load_specs(str(tmp_path / "empty.yaml"))


def test_jdbc_options():
    split = jdbc_options("jdbc:x", "dbo.t", "at", "2024-01-01", "2024-02-01", 8)
    assert (split["partitionColumn"], split["numPartitions"]) == ("at", "8")
    with pytest.raises(ValueError, match="bound"):
        jdbc_options("jdbc:x", "dbo.t", "at")
    assert callable(jdbc_table)


def test_timestamp_is_added_to_the_projection(spark):
    spec = TableSpec("dbo.num_crowd", "t", timestamp_col="recordtime", rename_map={"storeid": "store_id"})
    df = raw(spark, ("2024-01-01 10:00:00", 1, 2))
    assert project(df, spec).columns == ["storeid", "recordtime"]
    assert project(df, TableSpec("dbo.x", "x", incremental=False)).columns == df.columns


def test_extract_is_strictly_newer_than_the_mark(spark):
    df = raw(spark, ("2024-01-01 10:00:00", 1, 2), ("2024-01-01 10:00:00.000001", 1, 2))
    assert extract(df, TRAFFIC, "2024-01-01 10:00:00").count() == 1
    assert extract(df, TRAFFIC, "2024-01-01 10:00:00", lookback="1 second").count() == 2
    assert extract(df, TRAFFIC).count() == 2


def test_query_parameters(spark):
    assert query(spark, "SELECT ? + ? AS s", [1, 2]).first().s == 3
    assert query(spark, "SELECT :a AS s", {"a": 4}).first().s == 4
    assert query(spark, "SELECT 5 AS s").first().s == 5


# -- cleaning ------------------------------------------------------------------


def test_clock_correction_subtracts_and_may_add(spark):
    df = raw(spark, ("2024-01-01 00:10:00", 1, 28), ("2024-01-01 00:10:00", 1, 5))
    offsets = {"num_crowd": {28: 53, 5: -30}}
    wanted = {28: "2023-12-31 23:17:00", 5: "2024-01-01 00:40:00"}
    assert {r.storeid: str(r.recordtime) for r in clean.correct_clock(df, TRAFFIC, offsets).collect()} == wanted
    assert clean.correct_clock(df, TRAFFIC, {}) is df
    assert clean.correct_clock(df.drop("storeid"), TRAFFIC, offsets).columns == df.drop("storeid").columns
    many = {"num_crowd": offsets["num_crowd"] | {store: 1 for store in range(1000, 6000)}}
    corrected = clean.correct_clock(df, TRAFFIC, many)
    assert {r.storeid: str(r.recordtime) for r in corrected.collect()} == wanted
    assert "Join" not in plan_text(corrected)


def test_partition_columns_follow_the_corrected_time(spark):
    [row] = clean.clean(raw(spark, ("2024-01-01 00:10:00", 1, 28)), TRAFFIC).collect()
    assert (row.year, row.month) == (2023, 12)


def test_only_text_columns_are_stripped(spark):
    spec = TableSpec("t", "t", incremental=False, cleaning_rules=(CleaningRule("n"), CleaningRule("s"), CleaningRule("none")))
    df = spark.createDataFrame([(1, " a ")], "n int, s string")
    assert rows(clean.rename_and_strip(df, spec)) == [(1, "a")]


# -- contracts -----------------------------------------------------------------


def error_rows(spark, *records):
    at = datetime(2024, 1, 1, 10)
    return spark.createDataFrame([(i, s, code, at, code, "m") for i, s, code in records], RAW_ERRORS)


def test_all_failures_of_a_row_are_kept(spark):
    df = error_rows(spark, (1, None, 2), (1, 3, None), (2, 3, None), (None, None, 1))
    flagged = prepare(df, ERRORS)
    cases = quality.failure_cases(flagged).select("log_id", "column", "check", "failure_case")
    assert rows(cases) == sorted([
        (1, "log_id", "unique", "1"), (1, "store_id", "not_null", None), (1, "log_id", "unique", "1"),
        (None, "log_id", "not_null", None), (None, "store_id", "not_null", None),
    ], key=repr)
    assert [row.log_id for row in quality.accepted(flagged).collect()] == [2]


def test_a_hot_repeated_key_is_rejected_whole(spark):
    df = error_rows(spark, *[(7, 1, 1)] * 300, *[(i, 1, 1) for i in range(1000, 1600)])
    flagged = prepare(df, ERRORS)
    assert quality.rejected(flagged).count() == 300
    assert quality.accepted(flagged).count() == 600


def test_coercion_failures(spark):
    contract = quality.Contract((quality.Field("a", "int", at_least=0), quality.Field("b", "bigint", unique=True)))
    df = spark.createDataFrame([("1", "5"), ("x", "05"), ("-1", "6")], "a string, b string")
    assert rows(quality.failure_cases(quality.flag(df, contract)).select("column", "check", "failure_case")) == [
        ("a", "at_least:0", "-1"), ("a", "coerce:int", "x"), ("b", "unique", "05"), ("b", "unique", "5"),
    ]


def test_missing_column_is_an_error_and_extra_ones_go(spark):
    contract = quality.CONTRACTS["dim_stores"]
    df = spark.createDataFrame([(1, "a", 2)], "store_id bigint, store_name string, x int")
    assert quality.check_columns(df, contract).columns == ["store_id", "store_name"]
    with pytest.raises(ValueError, match="store_name"):
        quality.check_columns(df.drop("store_name"), contract)


def test_unrepresentable_count_is_rejected(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "1e30", "1", "d", 1)], "recordtime string, in_num string, out_num string, position string, storeid int")
    cases = quality.failure_cases(prepare(df, TRAFFIC)).select("column", "check").collect()
    assert [tuple(case) for case in cases] == [("visitors_in", "not_null")]


# -- loads ---------------------------------------------------------------------


def test_two_batches_equal_one(spark, sf_dir, tmp_path):
    from doorflux.plans.warehouse import Warehouse

    feed = fx.raw_traffic(spark, sf_dir)
    whole, parts = (Warehouse(spark, str(tmp_path / name)) for name in ("whole", "parts"))
    load_table(whole, TRAFFIC, feed)
    for cut in ("2024-01-05 03:00:00", CUT, "2024-01-16 12:00:00", "2024-02-01 00:00:00"):
        load_table(parts, TRAFFIC, feed.filter(F.col("recordtime") <= cut))
    assert rows(parts.table("fact_traffic")) == rows(whole.table("fact_traffic"))
    assert rows(buckets.trend(parts.traffic(hourly=True), EVENTS_MONTH)) == rows(
        buckets.trend(whole.traffic(), EVENTS_MONTH)
    )


def test_mark_is_the_source_time_in_microseconds(spark, warehouse):
    # Store 28 runs 53 minutes fast: the stored time is earlier than the mark.
    feed = raw(spark, ("2024-01-01 10:00:00.5", 1, 28))
    assert load_table(warehouse, TRAFFIC, feed).commit.mark == "2024-01-01 10:00:00.5"
    again = load_table(warehouse, TRAFFIC, feed)
    assert (again.load.rows, again.published, again.commit.version) == (0, False, 1)
    assert counted(warehouse) == [("2024-01-01 09:07:00.500000", 1, 28)]


def test_negative_offset_skips_nothing(spark, warehouse):
    offsets = {"num_crowd": {5: -60}}
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5)), offsets)
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5), ("2024-01-01 10:30:00", 2, 5)), offsets)
    assert counted(warehouse) == [("2024-01-01 11:00:00", 1, 5), ("2024-01-01 11:30:00", 2, 5)]


def test_late_row_is_found_only_with_a_lookback(spark, warehouse):
    late, seen = ("2024-01-01 09:00:00", 9, 28), ("2024-01-01 10:00:00", 1, 28)
    load_table(warehouse, TRAFFIC, raw(spark, seen))
    load_table(warehouse, TRAFFIC, raw(spark, late, seen))
    assert len(counted(warehouse)) == 1
    done = load_table(warehouse, TRAFFIC, raw(spark, late, seen), lookback="2 hours")
    assert (done.load.rows, done.commit.mark) == (1, "2024-01-01 10:00:00")
    assert counted(warehouse) == [("2024-01-01 08:07:00", 9, 28), ("2024-01-01 09:07:00", 1, 28)]
    assert load_table(warehouse, TRAFFIC, raw(spark, late, seen), lookback="2 hours").load.rows == 0


def test_rejected_rows_are_kept_apart(spark, warehouse):
    done = load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5), ("2024-01-01 11:00:00", 1, None)))
    assert (done.load.rows, done.load.rejected) == (1, 1)
    assert done.commit.mark == "2024-01-01 11:00:00"  # of all rows written
    [row] = warehouse.rejected("fact_traffic").collect()
    assert row[quality.FAILURES][0].column == "store_id"
    assert warehouse.rejected("fact_errors").count() == 0


def test_nothing_good_publishes_nothing(spark, warehouse):
    done = load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 11:00:00", 1, None)))
    assert (done.published, done.commit.version, done.commit.loads) == (False, 1, ())
    assert warehouse.table("fact_traffic").count() == 0
    assert warehouse.rollup().count() == 0
    assert warehouse.latest_record_time().first()[0] is None
    assert warehouse.rejected("fact_traffic").count() == 1


def test_bad_rows_are_kept_once(spark, warehouse):
    bad, good = ("2024-01-01 11:00:00", 1, None), ("2024-01-01 10:00:00", 2, 5)
    load_table(warehouse, TRAFFIC, raw(spark, bad))  # a load of bad rows only
    load_table(warehouse, TRAFFIC, raw(spark, bad, ("2024-01-01 12:00:00", 3, 5)))
    load_table(warehouse, TRAFFIC, raw(spark, bad, good, ("2024-01-01 12:00:00", 3, 5)))
    assert [row.visitors_in for row in warehouse.rejected("fact_traffic").collect()] == [1]
    assert [ins for _, ins, _ in counted(warehouse)] == [3]


def test_a_key_is_unique_over_all_loads(spark, warehouse):
    def feed(*records):
        rows_ = [(i, 5, 1, datetime(2024, 1, day), 1, "m") for i, day in records]
        return spark.createDataFrame(rows_, RAW_ERRORS)

    load_table(warehouse, ERRORS, feed((1, 1), (2, 1)))
    load_table(warehouse, ERRORS, feed((1, 2), (3, 2), (4, 2), (4, 2)))
    assert sorted(r.log_id for r in warehouse.table("fact_errors").collect()) == [1, 2, 3]
    assert sorted(r.log_id for r in warehouse.rejected("fact_errors").collect()) == [1, 4, 4]


def test_a_late_row_that_comes_twice_is_loaded_once(spark, warehouse):
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5)))
    late = ("2024-01-01 09:00:00", 7, 5)
    load_table(warehouse, TRAFFIC, raw(spark, late, late), lookback="2 hours")
    assert sorted(ins for _, ins, _ in counted(warehouse)) == [1, 7]


def test_hourly_sums_answer_only_for_their_rules(spark, warehouse):
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-05 10:00:00", 150, 5)))
    wide = BusinessRules(outlier_threshold=1000)
    for rules, wanted in ((BusinessRules(), 0), (wide, 150)):
        for hourly in (True, False):
            [(_, total)] = rows(buckets.trend(warehouse.traffic(rules, hourly), EVENTS_MONTH))
            assert total == wanted
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-05 11:00:00", 150, 5)), rules=wide)
    warehouse.compact(TRAFFIC)
    assert rows(buckets.trend(warehouse.traffic(wide, hourly=True), EVENTS_MONTH)) == [("2024-01-05", 300)]


def test_intervals(spark):
    assert spark.range(1).select(interval("1 hour 30 minutes").cast("long")).first()[0] == 5400
    for text in ("soon", "3", "1 day; DROP", "2 fortnights"):
        with pytest.raises(ValueError, match="interval"):
            interval(text)


def test_failed_attempt_stays_invisible_and_is_overwritten(spark, warehouse):
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5)))
    history = warehouse.history("fact_traffic")
    batch = raw(spark, ("2024-01-01 11:00:00", 2, 5))
    warehouse.write_load(prepare(batch, TRAFFIC), TRAFFIC, history.next_load_id)  # and no commit
    assert len(counted(warehouse)) == 1
    assert load_table(warehouse, TRAFFIC, batch).published
    assert [ins for _, ins, _ in counted(warehouse)] == [1, 2]


def test_unreadable_record_falls_back(spark, warehouse, tmp_path):
    for hour in (10, 11):
        load_table(warehouse, TRAFFIC, raw(spark, (f"2024-01-01 {hour}:00:00", hour, 5)))
    [part] = (tmp_path / "warehouse/fact_traffic/commits/v=2").glob("*.json")
    part.write_text("not json\n")
    part.with_name(f".{part.name}.crc").unlink()
    history = warehouse.history("fact_traffic")
    assert (history.current.version, history.newest) == (1, 2)
    assert history.mark == "2024-01-01 10:00:00"
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 11:00:00", 11, 5)))
    assert [ins for _, ins, _ in counted(warehouse)] == [10, 11]
    assert warehouse.commit("fact_traffic").version == 3


def test_full_load_replaces_while_readers_keep_theirs(spark, warehouse):
    def stores(*names):
        return spark.createDataFrame(list(enumerate(names)), "tid int, name string")

    load_table(warehouse, STORES, stores("a", "b"))
    before = warehouse.table("dim_stores")
    load_table(warehouse, STORES, stores("c"))
    assert rows(before) == [(0, "a"), (1, "b")]
    assert rows(warehouse.table("dim_stores")) == [(0, "c")]
    assert warehouse.commit("dim_stores").mark is None


def test_table_without_contract_is_not_checked(spark, warehouse):
    spec = TableSpec("dbo.other", "other", incremental=False, rename_map={"a": "b"})
    done = load_table(warehouse, spec, spark.createDataFrame([(1,)], "a int"))
    assert (done.load.rows, done.published) == (1, True)
    assert rows(warehouse.table("other")) == [(1,)]


def test_etl_goes_on_after_a_failure(spark, warehouse, sf_dir):
    sources = {STORES.source_table: fx.raw_stores(spark, sf_dir), TRAFFIC.source_table: fx.raw_traffic(spark, sf_dir)}
    figures = run_etl(warehouse, sources)
    assert [tuple(r) for r in figures.select("dest_table", "status").collect()] == [
        ("dim_stores", "succeeded"), ("fact_traffic", "succeeded"), ("fact_errors", "failed"),
    ]
    assert tuple(run_summary(figures).first()) == (3, 2, 1)
    warehouse.register_views()
    assert spark.table("v_traffic_normalized").count() == spark.table("fact_traffic").count() == 1000


def test_catalog_view_shows_the_published_version(spark, warehouse):
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-01 10:00:00", 1, 5), ("2024-01-01 10:00:00", 1, None)))
    warehouse.publish_to_catalog(TRAFFIC)
    assert spark.table("fact_traffic").count() == 1
    batch = raw(spark, ("2024-02-01 10:00:00", 2, 5))
    history = warehouse.history("fact_traffic")
    load = warehouse.write_load(prepare(batch, TRAFFIC), TRAFFIC, history.next_load_id)
    assert spark.table("fact_traffic").count() == 1  # written, not published
    warehouse.publish(TRAFFIC, load)
    warehouse.publish_to_catalog(TRAFFIC)
    assert rows(spark.table("fact_traffic")) == rows(warehouse.table("fact_traffic"))
    load_table(warehouse, STORES, spark.createDataFrame([(1, "a")], "tid int, name string"))
    warehouse.publish_to_catalog(STORES)
    described = spark.sql("DESCRIBE EXTENDED dim_stores_loads store_id").collect()
    assert ("distinct_count", "1") in [tuple(row) for row in described]


@pytest.fixture(autouse=True)
def clean_catalog(spark):
    yield
    for name in ("dim_stores", "fact_traffic", "fact_errors", "v_traffic_normalized"):
        spark.catalog.dropTempView(name)
    for name in ("dim_stores", "fact_traffic"):
        spark.sql(f"DROP VIEW IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_loads")


def test_compacting_changes_nothing_but_the_folders(spark, warehouse):
    for hour in (10, 11, 12):
        load_table(warehouse, TRAFFIC, raw(spark, (f"2024-01-05 {hour}:00:00", hour, 5), (f"2024-01-05 {hour}:00:00", 1, None)))
    before = rows(warehouse.table("fact_traffic")), warehouse.mark(TRAFFIC)
    trend = rows(buckets.trend(warehouse.traffic(hourly=True), EVENTS_MONTH))
    commit = warehouse.compact(TRAFFIC)
    assert (commit.version, commit.loads, len(commit.rejects)) == (4, ("C00000004",), 3)
    assert (rows(warehouse.table("fact_traffic")), warehouse.mark(TRAFFIC)) == before
    assert rows(buckets.trend(warehouse.traffic(hourly=True), EVENTS_MONTH)) == trend
    assert warehouse.rejected("fact_traffic").count() == 3
    assert warehouse.compact(TRAFFIC) == commit
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-05 13:00:00", 13, 5)))
    assert [ins for _, ins, _ in counted(warehouse)] == [10, 11, 12, 13]
    load_table(warehouse, TRAFFIC, raw(spark, ("2024-01-05 14:00:00", 14, 5)))
    assert warehouse.compact(TRAFFIC).loads == ("C00000004", "C00000007")  # what is compact stays
    assert [ins for _, ins, _ in counted(warehouse)] == [10, 11, 12, 13, 14]
    assert str(warehouse.latest_record_time().first()[0]) == "2024-01-05 14:00:00"


# -- plans ---------------------------------------------------------------------


def test_mark_and_columns_reach_the_scan(spark, sf_dir):
    plan = plan_text(extract(fx.raw_traffic(spark, sf_dir), TRAFFIC, CUT).select("recordtime", "storeid"))
    assert "GreaterThan(ts,2024-01-16T12:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_cleaning_is_one_projection(spark, sf_dir):
    plan = plan_text(clean.clean(fx.raw_traffic(spark, sf_dir), TRAFFIC))
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan
    assert "PushedFilters: [IsNotNull(ts)]" in plan
