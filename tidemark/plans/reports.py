"""The reference's dashboard reports over tables in its data model.

Tables (column names are the operators' defaults):

* customers:    customer_id, ...
* events:       event_id, customer_id, session_id, timestamp, event_type, device, ...
* transactions: transaction_id, customer_id, transaction_timestamp, amount, payment_method, status

Each function returns a lazy DataFrame; the caller decides to ``write`` it or
``toPandas`` it. Nothing is collected here, except where an operator says so
(cohort pivots read their observed offsets; RFM reads per-bucket counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import (
    DEFAULT_STAGES,
    audit,
    cohort_matrix,
    cohort_retention,
    event_mix,
    funnel_all,
    funnel_by_segment,
    funnel_segment,
    kpis,
    rfm_customers,
    rfm_segments,
)
from tidemark.sources.layout import read_laid_out


def load(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """customers, events and transactions from ``<data_dir>/<name>.parquet``, with
    the layouts they were written with (``sources.layout``), if any."""
    return {name: read_laid_out(spark, data_dir, name)
            for name in ("customers", "events", "transactions")}


def funnel_report(events: DataFrame, device: str | None = None) -> DataFrame:
    """Funnel by device; one device's rows, or all devices summed when ``device`` is None."""
    funnel = funnel_by_segment(events, DEFAULT_STAGES)
    return funnel_all(funnel) if device is None else funnel_segment(funnel, device)


def funnel_table(events: DataFrame) -> DataFrame:
    """The per-device funnel table as the reference's funnel query returns it."""
    return funnel_by_segment(events, DEFAULT_STAGES)


def cohort_report(events: DataFrame) -> DataFrame:
    return cohort_retention(events)


def cohort_heatmap(events: DataFrame) -> DataFrame:
    return cohort_matrix(cohort_retention(events, ordered=False))


def rfm_report(transactions: DataFrame) -> DataFrame:
    return rfm_segments(rfm_customers(transactions))


def quality_report(customers: DataFrame, events: DataFrame, transactions: DataFrame) -> DataFrame:
    return audit(customers, events, transactions)


def overview(customers: DataFrame, events: DataFrame, transactions: DataFrame) -> dict[str, DataFrame]:
    return {"kpis": kpis(customers, events, transactions), "event_mix": event_mix(events)}
