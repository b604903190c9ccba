"""Table sources: pandas-written files (nanosecond timestamps) and rewritten tables."""

from datetime import datetime

import pandas as pd

from conftest import event_log
from tidemark.plans import reports
from tidemark.sources.parquet import read_table, table_path


def test_reads_pandas_nanosecond_timestamps(spark, tmp_path):
    pdf = pd.DataFrame({
        "id": ["a", "b"],
        "ts": [pd.Timestamp("2025-01-01 10:00:00.123456789"), pd.Timestamp("2025-02-01")],
        "at": [pd.Timestamp("2025-01-01 10:00", tz="UTC"), pd.Timestamp("2025-02-01", tz="UTC")]})
    pdf.to_parquet(table_path(str(tmp_path), "events"), index=False)
    df = read_table(spark, str(tmp_path), "events")
    types = dict(df.dtypes)
    assert types["ts"] == "timestamp_ntz" and types["at"] == "timestamp"
    rows = {r["id"]: r for r in df.collect()}
    assert rows["a"]["ts"] == datetime(2025, 1, 1, 10, 0, 0, 123456)
    assert rows["b"]["ts"] == datetime(2025, 2, 1)


def test_reference_style_files_run_end_to_end(spark, tmp_path):
    """Data written the way the reference writes it (pandas -> Parquet)."""
    log = event_log(spark, """
        k7 mia web page_view    08:15
        k7 mia web product_view 08:15
        k7 mia web add_to_cart  09:40
    """).toPandas()
    log["timestamp"] = log["timestamp"].astype("datetime64[ns]")
    log.to_parquet(table_path(str(tmp_path), "events"), index=False)
    events = read_table(spark, str(tmp_path), "events")
    users = [r["unique_users"] for r in reports.funnel_table(events).collect()]
    assert users == [1, 1, 1, 0, 0]


def test_nanosecond_read_leaves_the_session_setting(spark, tmp_path):
    from tidemark.sources.parquet import NANOS_AS_LONG
    pd.DataFrame({"ts": [pd.Timestamp("1969-12-31 23:59:59.999999999")]}).astype(
        {"ts": "datetime64[ns]"}).to_parquet(table_path(str(tmp_path), "t"), index=False)
    before = spark.conf.get(NANOS_AS_LONG)
    df = read_table(spark, str(tmp_path), "t")
    assert spark.conf.get(NANOS_AS_LONG) == before
    assert df.collect()[0]["ts"] == datetime(1969, 12, 31, 23, 59, 59, 999999)
    named = read_table(spark, f"file://{tmp_path}", "t", nanos={"ts": True})
    assert dict(named.dtypes) == {"ts": "timestamp"} and named.count() == 1


def test_a_rewritten_table_is_read_with_its_new_columns(spark, tmp_path):
    path, base = table_path(str(tmp_path), "t"), f"file://{tmp_path}"
    pd.DataFrame({"a": [1, 2]}).to_parquet(path, index=False)
    assert read_table(spark, base, "t").columns == ["a"]
    pd.DataFrame({"renamed": ["x"], "b": [3]}).to_parquet(path, index=False)
    df = read_table(spark, base, "t")
    assert dict(df.dtypes) == {"renamed": "string", "b": "bigint"}
    assert [tuple(r) for r in df.collect()] == [("x", 3)]
