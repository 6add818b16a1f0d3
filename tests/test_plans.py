"""What the physical plans must and must not hold."""

from doorflux import Request
from pyspark.sql import functions as F

from doorflux.config import ERRORS, STORES, TRAFFIC, BusinessRules
from doorflux.operators import buckets, errors, filters, metrics, normalize, stores
from doorflux.plans.load import load_table
from tests.conftest import plan_text, rows
from workloads import fixtures as fx
from workloads.queries import EVENTS_MONTH, EVENTS_STORE


def test_range_is_pushed_through_the_view(spark, sf_dir):
    view = normalize.normalize(fx.events_fact(spark, sf_dir), fx.supplier_stores(spark, sf_dir))
    plan = plan_text(view.filter("record_time >= TIMESTAMP_NTZ '2024-01-05 09:00:00'"))
    assert "GreaterThanOrEqual(ts,2024-01-05T09:00)" in plan


def test_totals_of_all_stores_need_no_join(spark, sf_dir):
    plan = plan_text(buckets.trend(fx.events_traffic(spark, sf_dir), EVENTS_MONTH))
    assert "Join" not in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id" not in plan


def test_stores_are_joined_after_the_first_sum(spark, sf_dir):
    plan = plan_text(metrics.metrics(fx.events_traffic(spark, sf_dir), EVENTS_MONTH))
    assert plan.count("events.parquet") == 1  # one scan for all figures
    join = plan.index("BroadcastHashJoin")
    assert join < plan.index("partial_sum", join) < plan.index("events.parquet")


def test_chosen_store_comes_before_the_sums(spark, sf_dir):
    plan = plan_text(stores.store_comparison(fx.events_traffic(spark, sf_dir), EVENTS_STORE))
    semi = plan.index("LeftSemi")  # before anything is summed
    assert plan.rindex("partial_sum") < semi < plan.index("events.parquet")


def test_error_log_takes_the_newest_before_the_join(spark, sf_dir):
    plan = plan_text(errors.error_logs(fx.events_errors(spark, sf_dir), fx.supplier_stores(spark, sf_dir)))
    assert plan.index("Join") < plan.index("TakeOrderedAndProject")


def test_large_stores_table_is_not_broadcast(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_text(normalize.normalize(fx.events_fact(spark, sf_dir), fx.supplier_stores(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_share_computes_the_totals_once(spark, sf_dir):
    share = stores.store_share(fx.orders_traffic(spark, sf_dir), Request.of("year", "1997-01-01", "1997-12-31"))
    share.collect()
    final = plan_text(share).split("== Initial Plan")[0]
    assert "ReusedExchange" in final and "Window" not in final


def test_only_touched_partitions_are_read(spark, warehouse, sf_dir):
    load_table(warehouse, TRAFFIC, fx.raw_traffic(spark, sf_dir))
    for traffic in (warehouse.traffic(), warehouse.traffic(hourly=True)):
        for frame in (buckets.trend(traffic, EVENTS_MONTH), metrics.metrics(traffic, EVENTS_MONTH)):
            filters = plan_text(frame).split("PartitionFilters: [")[1].split("PushedFilters")[0]
            assert "year" in filters and "month" in filters


def test_newest_rows_come_from_the_newest_partitions(spark, warehouse, sf_dir):
    load_table(warehouse, ERRORS, fx.dirty_errors(spark, sf_dir))
    log, stores_ = warehouse.table("fact_errors"), fx.supplier_stores(spark, sf_dir)
    months = [row[0] for row in log.groupBy("year", "month").count().orderBy("year", "month").select("count").collect()]
    for limit in (1, months[-1], months[-1] + 1, 10_000):
        pruned = errors.error_logs(warehouse.newest("fact_errors", limit), stores_, limit)
        assert rows(pruned) == rows(errors.error_logs(log, stores_, limit))
    plan = plan_text(errors.error_logs(warehouse.newest("fact_errors", 1), stores_, 1))
    assert "month" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert plan.count("FileScan parquet") == 2  # the log and the stores: nothing is counted
    load_table(warehouse, TRAFFIC, fx.raw_traffic(spark, sf_dir))
    fact = warehouse.table("fact_traffic")
    assert rows(warehouse.latest_record_time()) == rows(fact.selectExpr("max(recorded_at)"))
    assert "FileScan" not in plan_text(warehouse.latest_record_time())


def test_any_error_is_enough(spark, sf_dir):
    assert "Limit" in plan_text(errors.has_errors(fx.events_errors(spark, sf_dir)))


def test_other_rules_are_answered_without_the_records(spark, warehouse, sf_dir):
    load_table(warehouse, TRAFFIC, fx.raw_traffic(spark, sf_dir))
    plan = plan_text(buckets.trend(warehouse.traffic(BusinessRules(outlier_threshold=40), hourly=True), EVENTS_MONTH))
    assert "grain=value" in plan and "fact_traffic" not in plan


def dense(spark, days=400):
    """A record of two stores every hour."""
    start = F.lit("2023-01-01").cast("timestamp_ntz")
    return spark.range(24 * days * 2).select(
        (start + F.make_dt_interval(F.lit(0), (F.col("id") / 2).cast("int"))).alias("recordtime"),
        (F.col("id") % 7).cast("int").alias("in_num"), (F.col("id") % 5).cast("int").alias("out_num"),
        F.lit("door").alias("position"), (F.col("id") % 2).cast("int").alias("storeid"),
    )


def test_business_days_answer_long_ranges(spark, warehouse):
    load_table(warehouse, TRAFFIC, dense(spark))
    whole, fast = warehouse.traffic(), warehouse.traffic(hourly=True)
    assert fast.days is not None
    for period, start, end in (
        ("year", "2023-01-01", "2023-12-31"), ("month", "2023-03-05", "2023-05-04"), ("week", "2023-03-05", "2023-03-05"),
        ("day", "2023-03-05", "2023-03-07"), ("year", "2022-01-01", "2030-01-01"), ("odd", "2023-02-01", "2023-02-28"),
    ):
        request = Request.of(period, start, end)
        assert rows(buckets.trend(fast, request)) == rows(buckets.trend(whole, request))
        assert rows(metrics.metrics(fast, request)) == rows(metrics.metrics(whole, request))
        assert rows(metrics.growth(fast, request)) == rows(metrics.growth(whole, request))
    year = Request.of("year", "2023-01-01", "2023-12-31")
    hours = filters.business_days(warehouse.traffic(hourly=True), year)
    records = filters.business_days(whole, year)
    assert 20 * hours.count() < records.count()
    late_close = BusinessRules(working_hour_end=11)  # beyond the next opening
    for traffic in (warehouse.traffic(late_close, hourly=True), warehouse.traffic(late_close)):
        total = rows(metrics.total_in(traffic, Request.of("month", "2023-03-05", "2023-03-06")))
        assert total == rows(metrics.total_in(warehouse.traffic(late_close), Request.of("month", "2023-03-05", "2023-03-06")))
    early = BusinessRules(working_hour_start=8)  # days that open otherwise: hours answer
    assert warehouse.traffic(early, hourly=True).days is None
    assert rows(buckets.trend(warehouse.traffic(early, hourly=True), year)) == rows(buckets.trend(warehouse.traffic(early), year))


def test_untouched_loads_are_not_read_for_unique_keys(spark, warehouse):
    def feed(first, day):
        return spark.range(first, first + 100).select(
            F.col("id").alias("ID"), F.lit(5).alias("storeid"), F.lit(1).cast("smallint").alias("DeviceCode"),
            F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz").alias("LogTime"), F.lit(1).alias("Errorcode"), F.lit("m").alias("ErrorMessage"),
        )

    for k in range(4):
        load_table(warehouse, ERRORS, feed(1000 * k, k + 1))
    for keys, loads in ((feed(2050, 9), {3}), (feed(5000, 9), set()), (feed(1050, 9).union(feed(3099, 9)), {2, 4})):
        found = warehouse.where_it_may_be("fact_errors", "log_id", keys, own="ID").inputFiles()
        assert {int(name.split("load_id=L")[1][:8]) for name in found} == loads
    done = load_table(warehouse, ERRORS, feed(2050, 9))
    assert (done.load.rows, done.load.rejected) == (50, 50)


def test_a_store_touches_few_files_of_a_clustered_load(spark, warehouse, monkeypatch):
    feed = dense(spark, 60).withColumn("storeid", (F.col("in_num") * 5 + F.col("out_num")).cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        load_table(warehouse, TRAFFIC, feed, cluster=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    fact = warehouse.table("fact_traffic")
    files = fact.select(F.input_file_name().alias("f"), "store_id").groupBy("f").agg(F.count_distinct("store_id").alias("n")).collect()
    assert len(files) >= 8
    touched = fact.filter("store_id = 17").select(F.input_file_name().alias("f")).distinct().count()
    assert touched * 3 <= len(files)
    load_table(warehouse, STORES, spark.createDataFrame([(17, "mine"), (18, "other")], "tid int, name string"))
    plan = plan_text(metrics.metrics(warehouse.traffic_of("mine"), Request.of("month", "2023-01-01", "2023-02-01", "mine")))
    assert "store_id = 17" in plan.replace("#", " ") or "EqualTo(store_id,17)" in plan
