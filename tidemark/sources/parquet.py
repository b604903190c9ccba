"""Parquet tables by name from a directory (one ``<name>.parquet`` per table).

The schema is taken from the files at every read; a caller who knows it passes
``schema`` and saves the footer job.

Nanosecond timestamps (what pandas writes for ``datetime64[ns]``, and so the
reference's data files) are not a Spark type: reading them fails with
``PARQUET_TYPE_ILLEGAL``. ``read_table`` then reads those columns as longs,
under an explicit schema, and turns them back into timestamps: naive ones into
``timestamp_ntz``, UTC-adjusted ones into ``timestamp``. No session setting
outlives the call. Spark's timestamps hold microseconds, so the nanoseconds
below are cut: events within one microsecond become ties (which qualify in the
ordered funnel).
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_path(base_dir: str, name: str) -> str:
    return os.path.join(base_dir, f"{name}.parquet")


NANOS_AS_LONG = "spark.sql.legacy.parquet.nanosAsLong"


def nanosecond_columns(path: str) -> dict[str, bool]:
    """Columns stored as nanosecond timestamps -> whether they are UTC-adjusted,
    from the Parquet footers (pyarrow; a path it cannot open raises)."""
    import pyarrow as pa
    import pyarrow.dataset as ds

    source = path.removeprefix("file://")
    if "://" in source:
        from pyarrow import fs
        filesystem, source = fs.FileSystem.from_uri(source)
        schema = ds.dataset(source, format="parquet", filesystem=filesystem).schema
    else:
        schema = ds.dataset(source, format="parquet").schema
    return {f.name: f.type.tz is not None for f in schema
            if pa.types.is_timestamp(f.type) and f.type.unit == "ns"}


def _long_schema(spark: SparkSession, path: str) -> StructType:
    """Spark's schema of the files with nanosecond columns as longs. The setting
    is needed to infer it, not to read with it, and is put back."""
    before = spark.conf.get(NANOS_AS_LONG)
    spark.conf.set(NANOS_AS_LONG, "true")
    try:
        return spark.read.parquet(path).schema
    finally:
        spark.conf.set(NANOS_AS_LONG, before)


def _read_nanos(spark: SparkSession, path: str, nanos: dict[str, bool]) -> DataFrame:
    df = spark.read.schema(_long_schema(spark, path)).parquet(path)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    for name, utc in nanos.items():
        # Floor, so that times before 1970 are cut the same way.
        micros = F.expr(f"(`{name}` - pmod(`{name}`, 1000)) div 1000")
        df = df.withColumn(name, F.timestamp_micros(micros) if utc
                           else F.timestamp_add("MICROSECOND", micros, epoch))
    return df


def read_table(spark: SparkSession, base_dir: str, name: str, *,
               schema: StructType | str | None = None,
               nanos: dict[str, bool] | None = None) -> DataFrame:
    """Read one table. Column pruning and filters of later operators reach the
    scan (``ReadSchema`` / ``PushedFilters`` in the plan).

    ``nanos`` names the nanosecond columns (-> UTC-adjusted or not) for storage
    whose footers the driver cannot open; otherwise they are looked up when
    Spark refuses the files for them.
    """
    path = table_path(base_dir, name)
    if schema is not None:
        return spark.read.schema(schema).parquet(path)
    if nanos is None:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PARQUET_TYPE_ILLEGAL":
                raise
        nanos = nanosecond_columns(path)
    return _read_nanos(spark, path, nanos)


def write_table(df: DataFrame, base_dir: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(table_path(base_dir, name))
