"""Table sources and sinks: Parquet by name, with or without a layout (buckets,
order, date partitions), and the check tables mapped to the reference's events /
transactions / customers model."""

from tidemark.sources import driver_tables
from tidemark.sources.layout import Layout, read_laid_out, read_layout, write_laid_out
from tidemark.sources.parquet import read_table, table_path, write_table

__all__ = ["Layout", "driver_tables", "read_laid_out", "read_layout", "read_table", "table_path",
           "write_laid_out", "write_table"]
