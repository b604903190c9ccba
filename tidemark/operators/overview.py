"""Overview figures: the KPI row and the event mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import money_sum, require_columns
from tidemark.functions.rounding import round_sql


def kpis(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
         customer: str = "customer_id", status: str = "status", completed="Completed",
         amount: str = "amount", money_scale: int | None = 2) -> DataFrame:
    """One row: total_customers (distinct ids), total_events, total_orders and
    total_revenue (``money_sum``, 2 places) over completed transactions.

    Each table is one aggregate; they meet as scalar subqueries (no join).
    """
    require_columns(customers, customer)
    require_columns(transactions, status, amount)
    n_events = events.agg(F.count(F.lit(1))).scalar()
    done = (transactions.where(F.col(status) == F.lit(completed))
            .agg(F.struct(F.count(F.lit(1)).alias("orders"),
                          money_sum(transactions, amount, money_scale).alias("revenue"))).scalar())
    return (customers.agg(F.count_distinct(customer).alias("total_customers"))
            .select("total_customers", n_events.alias("total_events"),
                    done.getField("orders").alias("total_orders"),
                    done.getField("revenue").alias("_revenue"))
            .select("total_customers", "total_events", "total_orders",
                    round_sql("_revenue", 2).alias("total_revenue")))


def event_mix(events: DataFrame, *, event_type: str = "event_type",
              ordered: bool = True) -> DataFrame:
    """Events per type, most frequent first."""
    require_columns(events, event_type)
    out = events.groupBy(event_type).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.col("count").desc()) if ordered else out
