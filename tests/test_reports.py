"""The dashboard reports over tables in the reference's layout, loaded from Parquet."""

from datetime import datetime

import pytest

from conftest import CUSTOMER_SCHEMA, EVENT_SCHEMA, TXN_SCHEMA, at, event
from tidemark.plans import reports
from tidemark.sources.parquet import write_table


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("data"))
    customers = spark.createDataFrame(
        [(f"C{i}", datetime(2025, 1, 1), "US", "mobile", "Organic") for i in range(1, 5)],
        CUSTOMER_SCHEMA)
    events = spark.createDataFrame(
        [event("E1", "C1", "S1", at("10:00"), "page_view"),
         event("E2", "C1", "S1", at("11:00"), "product_view"),
         event("E3", "C2", "S2", at("10:00"), "page_view", "app"),
         event("E4", "C2", "S3", at("10:00", "2024-10-20"), "page_view", "app"),
         event("E5", "C9", "S4", at("12:00", "2024-09-05"), "add_to_cart", "kiosk")], EVENT_SCHEMA)
    transactions = spark.createDataFrame(
        [("T1", "C1", at("08:00"), 10.0, "Card", "Completed"),
         ("T2", "C2", at("09:00"), 20.0, "Card", "Completed"),
         ("T3", "C3", at("10:00"), 5.0, "Card", "Refunded")], TXN_SCHEMA)
    for name, df in (("customers", customers), ("events", events), ("transactions", transactions)):
        write_table(df, root, name)
    return reports.load(spark, root)


def test_funnel_reports(tables):
    per_device = reports.funnel_table(tables["events"]).collect()
    assert {r["device"] for r in per_device} == {"web", "app", "kiosk"}
    total = {r["stage_order"]: r["unique_users"] for r in reports.funnel_report(tables["events"]).collect()}
    assert total[1] == 2 and total[2] == 1
    app = reports.funnel_report(tables["events"], "app").collect()
    assert [r["unique_users"] for r in app] == [1, 0, 0, 0, 0]


def test_cohort_reports(tables):
    long = reports.cohort_report(tables["events"]).collect()
    assert [(r["cohort_month"].month, r["period_offset"], r["active_users"]) for r in long] == \
        [(9, 0, 3), (9, 1, 1)]
    heat = reports.cohort_heatmap(tables["events"])
    assert heat.columns == ["cohort_month", "Month 0", "Month 1"]


def test_rfm_quality_and_overview(tables):
    seg = reports.rfm_report(tables["transactions"]).collect()
    assert sum(r["customer_count"] for r in seg) == 2
    audit = [tuple(r) for r in reports.quality_report(
        tables["customers"], tables["events"], tables["transactions"]).collect()]
    assert audit[1] == ("Referential Integrity Audit", 1, 0, 0)      # C9 has no customer row
    views = reports.overview(tables["customers"], tables["events"], tables["transactions"])
    assert views["kpis"].collect()[0]["total_revenue"] == 30.0
    assert views["event_mix"].collect()[0]["event_type"] == "page_view"
