"""Parquet tables with a layout: buckets, an order within files, date partitions.

A session-bucketed events table lets the funnel's windows run where the data
lies, with no exchange of events; a date partition lets a report of a few days
read only those days. Spark keeps such a layout in its catalog, not in the files.
``write_laid_out`` therefore leaves a description beside the files
(``<table>/_layout``), and ``read_laid_out`` registers the table from it, so that
any session finds the layout again.

Writing shuffles the rows once, by bucket, so that a bucket is one file for
each date. A bucket holds all rows of its keys: a key with a third of all rows
makes a large file, which is written as it streams and is read in one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import require_columns
from tidemark.sources.parquet import read_table, table_path

_DAY = "_day"            # the date partition, of ``Layout.day_of``


@dataclass(frozen=True)
class Layout:
    """``buckets`` files by the hash of ``bucket_by``; rows ordered by ``sort_by``
    within a file; one folder for each date of ``day_of`` (a time column; NULL
    times have a folder of their own)."""
    bucket_by: Sequence[str] = ()
    buckets: int = 0
    sort_by: Sequence[str] = ()
    day_of: str | None = None

    def __post_init__(self):
        if bool(self.bucket_by) != (self.buckets > 0):
            raise ValueError("a bucketed layout needs both bucket columns and a bucket count")
        if self.sort_by and not self.bucket_by:
            raise ValueError("an order within files needs buckets")
        if set(self.sort_by) & {_DAY} or set(self.bucket_by) & {_DAY}:
            raise ValueError(f"{_DAY} is the date partition's own column")


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}`" for n in names)


def _catalog_name(path: str) -> str:
    return f"tidemark_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def _literal(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _description(path: str) -> str:
    return f"{path.rstrip('/')}/_layout"


def write_laid_out(df: DataFrame, base_dir: str, name: str, layout: Layout) -> None:
    """Write a table with a layout, in place of one of that name. A column called
    ``_day`` is refused where dates are partitioned."""
    spark, path = df.sparkSession, table_path(base_dir, name)
    require_columns(df, *layout.bucket_by, *layout.sort_by, *([layout.day_of] if layout.day_of else []))
    if layout.day_of:
        if _DAY in df.columns:
            raise ValueError(f"{_DAY} is the date partition's own column")
        df = df.withColumn(_DAY, F.to_date(layout.day_of))
    schema, table = df.schema, _catalog_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    if layout.bucket_by:
        df = df.repartition(layout.buckets, *layout.bucket_by)
    writer = df.write.mode("overwrite").format("parquet").option("path", path)
    if layout.day_of:
        writer = writer.partitionBy(_DAY)
    if layout.bucket_by:
        writer = writer.bucketBy(layout.buckets, *layout.bucket_by)
        if layout.sort_by:
            writer = writer.sortBy(*layout.sort_by)
    writer.saveAsTable(table)
    described = json.dumps({"layout": asdict(layout), "schema": schema.json()})
    spark.createDataFrame([(described,)], "value string").coalesce(1).write.mode("overwrite").text(
        _description(path))


def read_layout(spark: SparkSession, base_dir: str, name: str) -> tuple[Layout, str] | None:
    """The layout and schema that stand beside a table's files; None: no layout."""
    try:
        rows = spark.read.text(_description(table_path(base_dir, name))).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    found = json.loads(rows[0]["value"])
    return Layout(**found["layout"]), found["schema"]


def read_laid_out(spark: SparkSession, base_dir: str, name: str, *, since=None,
                  until=None) -> DataFrame:
    """A table with the layout it was written with; one without a layout is read
    as ``read_table`` reads it.

    ``since`` and ``until`` (dates or times, both included; a date ends with its
    day) keep the rows of a span of time: of the table's partitions only those
    days are read.
    """
    found = read_layout(spark, base_dir, name)
    if found is None:
        if since is not None or until is not None:
            raise ValueError(f"{name} has no date partitions")
        return read_table(spark, base_dir, name)
    layout, schema = found
    path = table_path(base_dir, name)
    table = _catalog_name(path)
    if not spark.catalog.tableExists(table):
        from pyspark.sql.types import StructType
        fields = StructType.fromJson(json.loads(schema)).fields
        columns = ", ".join(f"{_quoted([f.name])} {f.dataType.simpleString()}" for f in fields)
        parts = f"PARTITIONED BY ({_DAY})" if layout.day_of else ""
        if layout.bucket_by:
            parts += f" CLUSTERED BY ({_quoted(layout.bucket_by)})"
            if layout.sort_by:
                parts += f" SORTED BY ({_quoted(layout.sort_by)})"
            parts += f" INTO {layout.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts} LOCATION {_literal(path)}")
        if layout.day_of:
            spark.sql(f"MSCK REPAIR TABLE {table}")
    spark.catalog.refreshTable(table)
    df = spark.table(table)
    if not layout.day_of:
        if since is not None or until is not None:
            raise ValueError(f"{name} has no date partitions")
        return df
    when = F.col(layout.day_of)
    if since is not None:
        df = df.where((F.col(_DAY) >= F.to_date(F.lit(since))) & (when >= F.lit(since)))
    if until is not None:
        import datetime
        whole_day = isinstance(until, datetime.date) and not isinstance(until, datetime.datetime)
        df = df.where((F.col(_DAY) <= F.to_date(F.lit(until))) & (
            (F.to_date(when) <= F.lit(until)) if whole_day else (when <= F.lit(until))))
    return df.drop(_DAY)
