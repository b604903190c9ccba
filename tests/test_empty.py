"""Every report on empty inputs: no failure, the documented empty or zero result."""

from pyspark.sql import functions as F

from conftest import CUSTOMER_SCHEMA, EVENT_SCHEMA, TXN_SCHEMA
from tidemark.operators import (
    audit,
    cohort_matrix_freq,
    cohort_retention,
    event_mix,
    funnel_all,
    funnel_by_segment,
    funnel_unordered,
    global_ntile,
    kpis,
    rfm_customers,
    rfm_segments,
)


def test_reports_on_empty_tables(spark):
    events = spark.createDataFrame([], EVENT_SCHEMA)
    txns = spark.createDataFrame([], TXN_SCHEMA)
    customers = spark.createDataFrame([], CUSTOMER_SCHEMA)
    assert funnel_by_segment(events).collect() == []
    assert funnel_all(funnel_by_segment(events, ordered=False)).collect() == []
    assert [r["users"] for r in funnel_unordered(events, "event_type", "customer_id",
                                                 ["page_view", "purchase"]).collect()] == [0, 0]
    assert cohort_retention(events).collect() == []
    assert cohort_matrix_freq(events, "customer_id", "timestamp", "W").collect() == []
    assert rfm_segments(rfm_customers(txns)).collect() == []
    assert [tuple(r)[1:] for r in audit(customers, events, txns).collect()] == [(0, 0, 0)] * 3
    assert kpis(customers, events, txns).collect()[0].asDict() == {
        "total_customers": 0, "total_events": 0, "total_orders": 0, "total_revenue": None}
    assert event_mix(events).collect() == []
    ids = spark.range(0).withColumn("v", F.col("id"))
    assert global_ntile(ids, [F.col("v")], 4, "t", partitions=3).collect() == []
