"""One key holding a third of all rows: results stay exact on many partitions
(the plans combine map-side before every shuffle, see test_plans.py)."""

import random
from datetime import datetime, timedelta

from conftest import CUSTOMER_SCHEMA, EVENT_SCHEMA, TXN_SCHEMA
from tidemark.operators import audit, cohort_retention, rfm_base


def test_hot_user_cohort(spark):
    rnd = random.Random(1)
    start = datetime(2025, 1, 1)
    rows = []
    for i in range(3000):
        user = "HOT" if i % 3 == 0 else f"u{rnd.randint(0, 199)}"
        rows.append((f"e{i}", user, "s", start + timedelta(days=rnd.randint(0, 300)), "x", "d", "p"))
    df = spark.createDataFrame(rows, EVENT_SCHEMA).repartition(8)
    months = {}
    for _, user, _, when, *_ in rows:
        months.setdefault(user, set()).add((when.year, when.month))
    expect = {}
    for user, ms in months.items():
        first = min(ms)
        for m in ms:
            key = (first, (m[0] - first[0]) * 12 + m[1] - first[1])
            expect[key] = expect.get(key, 0) + 1
    got = {((r["cohort_month"].year, r["cohort_month"].month), r["period_offset"]): r["active_users"]
           for r in cohort_retention(df).collect()}
    assert got == expect


def test_hot_customer_rfm_and_hot_null_ids_in_audit(spark):
    rnd = random.Random(2)
    txns = [(f"t{i}", "HOT" if i % 3 == 0 else f"c{rnd.randint(0, 99)}",
             datetime(2025, 6, 1) - timedelta(days=rnd.randint(0, 60)),
             float(rnd.randint(1, 500)), "card", "Completed") for i in range(3000)]
    df = spark.createDataFrame(txns, TXN_SCHEMA).repartition(8)
    hot = {r["customer_id"]: r for r in rfm_base(df).collect()}["HOT"]
    assert hot["frequency"] == 1000
    assert hot["monetary"] == sum(t[3] for t in txns if t[1] == "HOT")

    events = spark.createDataFrame(
        [(None if i % 3 == 0 else f"e{i}", f"c{i % 50}", "s", datetime(2025, 1, 1), "x", "d", "p")
         for i in range(3000)], EVENT_SCHEMA).repartition(8)
    customers = spark.createDataFrame([(f"c{i}", datetime(2025, 1, 1), "US", "m", "o")
                                       for i in range(50)], CUSTOMER_SCHEMA)
    rows = [tuple(r) for r in audit(customers, events, df).collect()]
    assert rows[0][2] == 1000                 # NULL event ids: a third of the rows
    assert rows[2][2] == 1                    # the NULL id is the one repeated id
    known = {f"c{i}" for i in range(50)}
    assert rows[1][2] == len({t[1] for t in txns} - known)    # c50..c99 and HOT
