"""Counter data derived from the test tables, in Spark and as SQL.

Each fixture exists twice with the same columns and values: a function that
returns a DataFrame, and a SQL text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorflux.operators.normalize import Traffic


# The columns of the test tables. Given, they need not be inferred.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k")


# -- warehouse-shaped tables ---------------------------------------------------


def events_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("recorded_at"),
        F.floor("value").cast("bigint").alias("visitors_in"),
        _k().cast("bigint").alias("visitors_out"),
        F.col("user_id").alias("store_id"),
    )


def supplier_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name")
    )


def orders_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("recorded_at"),
        F.floor(F.col("o_totalprice") / 4000).cast("bigint").alias("visitors_in"),
        (F.col("o_custkey") % 97).alias("visitors_out"),
        (F.col("o_custkey") % 30).alias("store_id"),
    )


def nation_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("n_regionkey") % 2 == 0, "north").otherwise("south")
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("store_id"),
        F.concat("n_name", F.lit(" ("), side, F.lit(")")).alias("store_name"),
    )


def lineitem_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("recorded_at"),
        F.floor(F.col("l_quantity") * 2.5).cast("bigint").alias("visitors_in"),
        F.floor("l_quantity").cast("bigint").alias("visitors_out"),
        F.col("l_suppkey").alias("store_id"),
    )


def events_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return errors.select(
        F.col("event_id").alias("log_id"),
        F.col("user_id").alias("store_id"),
        (F.col("user_id") % 8).cast("int").alias("device_code"),
        F.col("ts").alias("logged_at"),
        _k().cast("int").alias("error_code"),
        F.trim("event_type").alias("error_message"),
    )


def events_traffic(spark: SparkSession, sf_dir: str) -> Traffic:
    return Traffic.from_fact(events_fact(spark, sf_dir), supplier_stores(spark, sf_dir))


def orders_traffic(spark: SparkSession, sf_dir: str) -> Traffic:
    return Traffic.from_fact(orders_fact(spark, sf_dir), nation_stores(spark, sf_dir))


def lineitem_traffic(spark: SparkSession, sf_dir: str) -> Traffic:
    return Traffic.from_fact(lineitem_fact(spark, sf_dir), supplier_stores(spark, sf_dir))


EVENTS_FACT = """
SELECT ts AS recorded_at, CAST(floor(value) AS BIGINT) AS visitors_in,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS visitors_out,
       user_id AS store_id
FROM events"""

SUPPLIER_STORES = "SELECT s_suppkey AS store_id, s_name AS store_name FROM supplier"

ORDERS_FACT = """
SELECT o_orderdate AS recorded_at,
       CAST(floor(o_totalprice / 4000) AS BIGINT) AS visitors_in,
       o_custkey % 97 AS visitors_out, o_custkey % 30 AS store_id
FROM orders"""

NATION_STORES = """
SELECT CAST(n_nationkey AS BIGINT) AS store_id,
       concat(n_name, ' (', CASE WHEN n_regionkey % 2 = 0 THEN 'north' ELSE 'south' END, ')') AS store_name
FROM nation"""

LINEITEM_FACT = """
SELECT l_shipdate AS recorded_at, CAST(floor(l_quantity * 2.5) AS BIGINT) AS visitors_in,
       CAST(floor(l_quantity) AS BIGINT) AS visitors_out, l_suppkey AS store_id
FROM lineitem"""

EVENTS_ERRORS = """
SELECT event_id AS log_id, user_id AS store_id, CAST(user_id % 8 AS INTEGER) AS device_code,
       ts AS logged_at, CAST(json_extract_string(props, '$.k') AS INTEGER) AS error_code,
       trim(event_type) AS error_message
FROM events WHERE event_type = 'error'"""


# -- raw, dirty source tables --------------------------------------------------
#
# The dirt follows the values: texts that are no number, missing and negative
# counts, padded texts, unreadable times, missing store ids, repeated keys.

RAW_TRAFFIC_SCHEMA = "recordtime timestamp_ntz, in_num int, out_num int, position string, storeid int"


def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("tid"),
        F.rpad(F.when(F.col("s_acctbal") >= 0, F.col("s_name")), 80, " ").alias("name"),
    )


def raw_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean feed in the source's own types; positions padded to 30."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("recordtime"),
        F.floor("value").cast("int").alias("in_num"),
        _k().cast("int").alias("out_num"),
        F.rpad("event_type", 30, " ").alias("position"),
        F.col("user_id").cast("int").alias("storeid"),
    )


def dirty_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of texts with every kind of fault the cleaning handles."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(value < 1, "bad").when(value >= 1.5, F.col("ts").cast("string")).alias("recordtime"),
        F.when(value < 3, "abc")
        .when(value < 5, None)
        .when(value < 8, F.concat(F.lit("-"), value.cast("string")))
        .when(value < 10, F.lit("1e2"))
        .otherwise(F.concat(F.lit(" "), value.cast("string"), F.lit(" ")))
        .alias("in_num"),
        F.when(kind != "click", _k()).alias("out_num"),
        F.concat(F.lit(" \t"), kind, F.lit("\n  ")).alias("position"),
        F.when(kind == "view", F.concat(F.lit("s"), F.col("user_id").cast("string")))
        .when(value < 200, F.col("user_id").cast("string"))
        .alias("storeid"),
    )


def dirty_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with repeated log ids, missing stores, codes and messages."""
    value, kind = F.col("value"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.when(kind == "signup", F.col("user_id")).otherwise(F.col("event_id")).alias("ID"),
        F.when(value < 150, F.col("user_id")).cast("int").alias("storeid"),
        F.when(kind != "view", F.col("user_id") % 8).cast("smallint").alias("DeviceCode"),
        F.when(value >= 1, F.col("ts")).alias("LogTime"),
        F.when(kind != "click", _k().cast("int")).alias("Errorcode"),
        F.when(kind != "purchase", F.concat(F.lit("  "), kind, F.lit(" "))).alias("ErrorMessage"),
    )


RAW_STORES = """
SELECT CAST(s_suppkey AS INTEGER) AS tid,
       rpad(CASE WHEN s_acctbal >= 0 THEN s_name END, 80, ' ') AS name
FROM supplier"""

RAW_TRAFFIC = """
SELECT ts AS recordtime, CAST(floor(value) AS INTEGER) AS in_num,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS out_num,
       rpad(event_type, 30, ' ') AS position, CAST(user_id AS INTEGER) AS storeid
FROM events"""

DIRTY_TRAFFIC = """
SELECT CASE WHEN value < 1 THEN 'bad' WHEN value >= 1.5 THEN CAST(ts AS VARCHAR) END AS recordtime,
       CASE WHEN value < 3 THEN 'abc' WHEN value < 5 THEN NULL
            WHEN value < 8 THEN concat('-', CAST(value AS VARCHAR))
            WHEN value < 10 THEN '1e2'
            ELSE concat(' ', CAST(value AS VARCHAR), ' ') END AS in_num,
       CASE WHEN event_type <> 'click' THEN json_extract_string(props, '$.k') END AS out_num,
       concat(' ', chr(9), event_type, chr(10), '  ') AS position,
       CASE WHEN event_type = 'view' THEN concat('s', CAST(user_id AS VARCHAR))
            WHEN value < 200 THEN CAST(user_id AS VARCHAR) END AS storeid
FROM events"""

DIRTY_ERRORS = """
SELECT CASE WHEN event_type = 'signup' THEN user_id ELSE event_id END AS ID,
       CAST(CASE WHEN value < 150 THEN user_id END AS INTEGER) AS storeid,
       CAST(CASE WHEN event_type <> 'view' THEN user_id % 8 END AS SMALLINT) AS DeviceCode,
       CASE WHEN value >= 1 THEN ts END AS LogTime,
       CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS Errorcode,
       CASE WHEN event_type <> 'purchase' THEN concat('  ', event_type, ' ') END AS ErrorMessage
FROM events"""
