"""Operators take their column names as parameters: renamed inputs give the
same results as the reference's default names."""

from datetime import datetime

from conftest import EVENT_SCHEMA, TXN_SCHEMA, at, event
from tidemark.operators import cohort_retention, funnel_by_segment, rfm_customers

RENAMES = {"customer_id": "uid", "session_id": "sid", "timestamp": "at",
           "event_type": "kind", "device": "country"}


def _rename(df, mapping):
    for old, new in mapping.items():
        df = df.withColumnRenamed(old, new)
    return df


def test_funnel_and_cohort_with_other_column_names(spark):
    events = spark.createDataFrame(
        [event("A", "U1", "S1", at("01:00"), "page_view", "NL"),
         event("B", "U1", "S1", at("02:00"), "product_view", "NL"),
         event("C", "U2", "S2", at("02:00", "2024-10-03"), "page_view", "DE")], EVENT_SCHEMA)
    renamed = _rename(events, RENAMES)
    base = [tuple(r) for r in funnel_by_segment(events).collect()]
    other = [tuple(r) for r in funnel_by_segment(
        renamed, session="sid", user="uid", segment="country", ts="at", event_type="kind").collect()]
    assert other == base
    assert funnel_by_segment(renamed, session="sid", user="uid", segment="country", ts="at",
                             event_type="kind").columns[0] == "country"
    assert [tuple(r) for r in cohort_retention(renamed, user="uid", ts="at").collect()] == \
        [tuple(r) for r in cohort_retention(events).collect()]


def test_rfm_with_other_column_names_and_status(spark):
    rows = [(f"T{i}", f"C{i % 3}", datetime(2025, 6, 1 + i % 5), 10.0 + i, "x", "OK" if i % 4 else "NO")
            for i in range(12)]
    txns = spark.createDataFrame(rows, TXN_SCHEMA)
    renamed = _rename(txns, {"transaction_id": "tid", "customer_id": "cid",
                             "transaction_timestamp": "when", "amount": "price", "status": "state"})
    a = sorted(tuple(r) for r in rfm_customers(txns, completed="OK").collect())
    b = sorted(tuple(r) for r in rfm_customers(renamed, customer="cid", ts="when", txn_id="tid",
                                               amount="price", status="state",
                                               completed="OK").collect())
    assert a == b and len(a) == 3
