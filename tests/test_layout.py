"""Tables with a layout: written, found again by another catalog, read by parts."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import at, event, EVENT_SCHEMA
from tidemark.operators import funnel_by_segment
from tidemark.plans.inspect import plan_text
from tidemark.sources import Layout, read_laid_out, read_layout, write_laid_out, write_table
from tidemark.sources.layout import _catalog_name
from tidemark.sources.parquet import table_path

STAGES = ["look", "buy"]


@pytest.fixture(scope="module")
def log(spark):
    rows = [event(f"e{i}", f"u{i % 17}", None if i % 13 == 0 else f"s{i % 29}",
                  None if i % 31 == 0 else at(f"{i % 24:02}:00", f"2024-09-{i % 9 + 1:02}"),
                  STAGES[i % 2], f"d{i % 3}") for i in range(900)]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def forget(spark, base, name):
    """What another session's catalog knows of a table: nothing."""
    spark.sql(f"DROP TABLE IF EXISTS {_catalog_name(table_path(base, name))}")


@pytest.mark.parametrize("layout", [
    Layout(), Layout(["session_id"], 3), Layout(["session_id", "device"], 2, ["timestamp"]),
    Layout(day_of="timestamp"), Layout(["session_id"], 3, ["session_id", "timestamp"], "timestamp")])
def test_a_table_comes_back_with_its_layout(spark, log, tmp_path, layout):
    base = str(tmp_path / "it's here")
    for df in (log, log.where("device = 'd1'")):        # written, and written again
        write_laid_out(df, base, "events", layout)
        assert same(df, read_laid_out(spark, base, "events"))
        forget(spark, base, "events")
        back = read_laid_out(spark, base, "events")
        assert back.columns == df.columns and same(df, back)
        assert read_layout(spark, base, "events")[0].buckets == layout.buckets


def test_an_empty_table(spark, log, tmp_path):
    write_laid_out(log.limit(0), str(tmp_path), "events", Layout(["session_id"], 2, day_of="timestamp"))
    assert read_laid_out(spark, str(tmp_path), "events").count() == 0


def test_a_table_without_a_layout(spark, log, tmp_path):
    write_table(log, str(tmp_path), "events")
    assert read_layout(spark, str(tmp_path), "events") is None
    assert same(log, read_laid_out(spark, str(tmp_path), "events"))
    with pytest.raises(ValueError):
        read_laid_out(spark, str(tmp_path), "events", since=date(2024, 9, 1))


def test_a_span_reads_its_days_only(spark, log, tmp_path):
    write_laid_out(log, str(tmp_path), "events", Layout(day_of="timestamp"))
    for since, until, rows in [
        (date(2024, 9, 3), date(2024, 9, 4), "date(timestamp) BETWEEN DATE'2024-09-03' AND DATE'2024-09-04'"),
        (datetime(2024, 9, 3, 12), None, "timestamp >= TIMESTAMP_NTZ'2024-09-03 12:00:00'"),
        (None, datetime(2024, 9, 2, 5), "timestamp <= TIMESTAMP_NTZ'2024-09-02 05:00:00'")]:
        part = read_laid_out(spark, str(tmp_path), "events", since=since, until=until)
        assert same(log.where(rows), part) and part.count() > 0
    files = {r[0].rsplit("_day=")[1][:10] for r in
             read_laid_out(spark, str(tmp_path), "events", since=date(2024, 9, 3), until=date(2024, 9, 4))
             .select(F.input_file_name()).distinct().collect()}
    assert files == {"2024-09-03", "2024-09-04"}
    assert "PartitionFilters: [isnotnull(_day" in plan_text(
        read_laid_out(spark, str(tmp_path), "events", since=date(2024, 9, 3)))


def test_a_funnel_over_buckets_exchanges_no_events(spark, log, tmp_path):
    write_laid_out(log, str(tmp_path), "events", Layout(["session_id"], 8, ["session_id"]))
    forget(spark, str(tmp_path), "events")
    report = funnel_by_segment(read_laid_out(spark, str(tmp_path), "events"), STAGES, ordered=False)
    assert same(funnel_by_segment(log, STAGES, ordered=False), report)
    keys = re.findall(r"Exchange hashpartitioning\(([^,)]*)", plan_text(report, "simple"))
    assert keys and not any(k.startswith("_s") for k in keys)


def test_layouts_that_cannot_be(spark, log, tmp_path):
    for bad in (lambda: Layout(["a"]), lambda: Layout(buckets=2), lambda: Layout(sort_by=["a"]),
                lambda: write_laid_out(log, str(tmp_path), "t", Layout(["nowhere"], 2)),
                lambda: write_laid_out(log.withColumn("_day", F.lit(1)), str(tmp_path), "t",
                                       Layout(day_of="timestamp"))):
        with pytest.raises(ValueError):
            bad()
