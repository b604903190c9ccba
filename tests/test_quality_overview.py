"""Data-quality audit and overview figures."""

import pytest

from conftest import CUSTOMER_SCHEMA, EVENT_SCHEMA, TXN_SCHEMA, at, event
from tidemark.operators import (
    audit,
    business_rule_audit,
    event_mix,
    kpis,
    null_key_audit,
    orphan_audit,
)
from tidemark.plans.inspect import plan_text

NOON = at("12:00")


def _customers(spark, ids):
    return spark.createDataFrame([(i, NOON, "PT", "web", "Referral") for i in ids], CUSTOMER_SCHEMA)


def _events(spark, pairs, kind="page_view"):
    return spark.createDataFrame([event(e, c, "s", NOON, kind) for e, c in pairs], EVENT_SCHEMA)


def _txns(spark, rows):
    return spark.createDataFrame([(t, c, NOON, a, "Card", s) for t, c, a, s in rows], TXN_SCHEMA)


@pytest.fixture(scope="module")
def shop(spark):
    """Three known customers and several defects of every class."""
    customers = _customers(spark, ["k1", "k2", "k3", None, None])
    events = _events(spark, [("ev1", "k1"), ("ev2", "k2"), ("ev2", "k3"), ("ev2", "k1"),
                             ("ev3", "x7"), ("ev4", "x7"), ("ev5", "x8"),
                             (None, "k1"), ("ev6", None), (None, None)])
    txns = _txns(spark, [("t1", "k1", 12.0, "Completed"), ("t2", "x7", 0.0, "Completed"),
                         ("t3", "x9", -4.0, "Failed"), (None, "k2", 3.0, "Completed"),
                         ("t5", "k3", None, "Completed"), ("t6", None, float("nan"), "Refunded")])
    return customers, events, txns


def test_audit_counts_every_defect(shop):                     # E23 to E25, P8
    out = audit(*shop)
    assert out.columns == ["audit_category", "missing_customer_ids", "missing_event_keys",
                           "missing_txn_keys"]
    assert [tuple(r) for r in out.collect()] == [
        ("Null Key Audit", 2, 3, 2),
        # x7 and x8 among the events, x7 and x9 among the transactions
        ("Referential Integrity Audit", 2, 2, 0),
        # 0.0 and -4.0 (not NULL, not NaN); ids seen again: ev2, NULL
        ("Business Rule Audit", 2, 2, 0)]


def test_single_audit_rows_equal_the_audit(shop):
    rows = [tuple(r) for part in (null_key_audit, orphan_audit, business_rule_audit)
            for r in part(*shop).collect()]
    assert rows == [tuple(r) for r in audit(*shop).collect()]


def test_null_key_row_neither_shuffles_ids_nor_joins(shop):
    text = plan_text(null_key_audit(*shop))
    assert "hashpartitioning" not in text and "Join" not in text


def test_sound_tables_give_zeros(spark):
    ids = [f"k{i}" for i in range(20)]
    out = audit(_customers(spark, ids), _events(spark, [(f"ev{i}", c) for i, c in enumerate(ids)]),
                _txns(spark, [(f"t{i}", c, 0.01 + i, "Completed") for i, c in enumerate(ids)]))
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0)] * 3


def test_kpis(spark, shop):
    customers, events, _ = shop
    txns = _txns(spark, [("t1", "k1", 12.5, "Completed"), ("t2", "k1", 0.75, "Completed"),
                         ("t3", "k2", 80.0, "Refunded")])
    assert kpis(customers, events, txns).collect()[0].asDict() == {
        "total_customers": 3, "total_events": 10, "total_orders": 2, "total_revenue": 13.25}


def test_event_mix_most_frequent_first(spark):
    events = _events(spark, [("m1", "k1"), ("m2", "k1")]).unionByName(
        _events(spark, [("m3", "k2")], "purchase"))
    assert [tuple(r) for r in event_mix(events).collect()] == [("page_view", 2), ("purchase", 1)]


def test_audit_joins_nothing(shop):
    text = plan_text(audit(*shop))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Join" not in text and "Window" not in text
