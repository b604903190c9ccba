"""Read a DataFrame's physical plan: used by tests to pin plan shapes
(exchanges, pushed filters, pruned scans) and by the bench's notes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The ``explain`` output as a string (before AQE re-planning)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def final_plan_text(df: DataFrame) -> str:
    """The executed plan after ``collect`` (AQE's final plan)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def count_ops(text: str, pattern: str) -> int:
    return len(re.findall(pattern, text))


def exchanges(text: str) -> list[str]:
    """Partitioning arguments of every Exchange in a formatted plan."""
    return re.findall(r"Arguments: ((?:hashpartitioning|rangepartitioning|SinglePartition|"
                      r"RoundRobinPartitioning)[^\n]*)", text)
