"""The check tables (``region nation customer ... events``) seen through the
reference's data model: events with sessions and devices, transactions,
customers.

The check data has no session, device or transaction table of its own, so
each is derived with expressions that Spark and the SQL oracle both have.
Every mapping reads whole tables: no row is filtered out or sampled. The
SQL text of each mapping sits next to its Spark form so the two stay equal.

* events: session = user and calendar day; device from the integer in
  ``props`` (``$.k``) modulo 3, so one session can span devices.
* transactions: orders, completed = order status ``F``.
* audit inputs: the same tables with defects written in (not filtered):
  customer ids blanked for ``c_custkey % 100 = 3`` (so their events and
  orders become orphans against a registry that also holds NULL ids),
  event customer blanked for every 50th event, event ids below 100 halved
  (duplicates), order customer blanked for every 50th order, and amounts
  shifted down by 5,000 (some become <= 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.parquet import read_table

# Mapping constants (fixed values of this mapping).
STAGES = ("view", "click", "signup", "purchase")
DEVICES = ("desktop", "mobile", "tablet")
COMPLETED = "F"


def _device(props):
    k = F.get_json_object(props, "$.k").cast("int") % 3
    return (F.when(k == 0, F.lit(DEVICES[0])).when(k == 1, F.lit(DEVICES[1]))
            .when(k == 2, F.lit(DEVICES[2])))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("customer_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.to_date("ts").cast("string")).alias("session_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type"),
        _device(F.col("props")).alias("device"),
        F.col("value"))


EVENTS_SQL = f"""
SELECT event_id,
       user_id AS customer_id,
       CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
       ts AS "timestamp",
       event_type,
       CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 3
            WHEN 0 THEN '{DEVICES[0]}' WHEN 1 THEN '{DEVICES[1]}' WHEN 2 THEN '{DEVICES[2]}' END AS device,
       value
FROM events"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("transaction_timestamp"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"))


TRANSACTIONS_SQL = """
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id,
       o_orderdate AS transaction_timestamp, o_totalprice AS amount, o_orderstatus AS status
FROM orders"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))


CUSTOMERS_SQL = """
SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer"""


def audit_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.when(F.col("c_custkey") % 100 == 3, F.lit(None))
                    .otherwise(F.col("c_custkey")).alias("customer_id"))


AUDIT_CUSTOMERS_SQL = """
SELECT CASE WHEN c_custkey % 100 = 3 THEN NULL ELSE c_custkey END AS customer_id FROM customer"""


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return ev.select(
        F.when(eid < 100, F.floor(eid / 2)).otherwise(eid).cast("long").alias("event_id"),
        F.when(eid % 50 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("customer_id"))


AUDIT_EVENTS_SQL = """
SELECT CASE WHEN event_id < 100 THEN event_id // 2 ELSE event_id END AS event_id,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS customer_id
FROM events"""


def audit_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit(None))
        .otherwise(F.col("o_custkey")).alias("customer_id"),
        (F.col("o_totalprice") - F.lit(5000.0)).alias("amount"))


AUDIT_TRANSACTIONS_SQL = """
SELECT o_orderkey AS transaction_id,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS customer_id,
       o_totalprice - 5000.0 AS amount
FROM orders"""
