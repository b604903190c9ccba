"""Recency / frequency / monetary scoring and segments.

* ``rfm_base``     - per customer over completed rows: recency_days (days
  from the customer's last completed transaction to the latest completed
  transaction of anyone), frequency (count of transaction ids), monetary.
* ``rfm_scores``   - three NTILE quartiles: recency descending, frequency and
  monetary ascending, customer id breaking ties; NULLs sort last both ways.
* ``rfm_label``    - total score and the segment label.
* ``rfm_segments`` - the reference's RFM report, one row per segment.

Money: ``money_sum``, the plain sum of the amounts; exact, and so independent
of task order, wherever they are whole cents (``money_scale`` places).

Plan shape: one aggregation of the completed rows by customer (partial
aggregation first), checkpointed once, since the quartiles read it; the
reference date is observed on the totals as they are written, so the
transactions are read once; quantile sketches and counts narrow the customers down to the
few about each quartile's end, and all customers are scored by comparison with
the nine cut rows (``ntile_columns``): no customer is moved, and the plan is the
same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.columns import money_sum, require_columns, sort_bounded
from tidemark.functions.rounding import round_sql
from tidemark.operators.ntile import ntile_columns
from tidemark.session import ensure_checkpoint_dir

# Segment labels of the reference, in rule order (fixed values).
CHAMPIONS = "Champions"
LOYAL = "Loyal Customers"
PROMISING = "Promising / Recent"
AT_RISK = "At Risk"
CHURNED = "Needs Attention / Churned"


def _customer_totals(transactions: DataFrame, customer: str, ts: str, txn_id: str,
                     amount: str, status: str, completed, money_scale: int | None) -> DataFrame:
    """customer, _last (latest completed time), frequency, monetary per customer."""
    require_columns(transactions, customer, ts, txn_id, amount, status)
    done = transactions.where(F.col(status) == F.lit(completed))
    return done.groupBy(customer).agg(
        F.max(ts).alias("_last"),
        F.count(txn_id).alias("frequency"),
        money_sum(done, amount, money_scale).alias("monetary"))


def _written(totals: DataFrame) -> tuple[DataFrame, Column]:
    """The totals checkpointed, and the latest time of all (as a date), which an
    observation takes from the rows on their way. A maximum does not mind
    that a task is run twice."""
    ensure_checkpoint_dir(totals.sparkSession)
    seen = Observation()
    latest = F.unix_date(F.max("_last").cast("date")).alias("latest")
    frozen = totals.observe(seen, latest).checkpoint(eager=True)
    day = seen.get["latest"]
    return frozen, F.date_from_unix_date(F.lit(day).cast("int"))


def _with_recency(totals: DataFrame, customer: str, reference_date: Column) -> DataFrame:
    return totals.select(
        customer,
        F.datediff(reference_date, F.col("_last")).cast("long").alias("recency_days"),
        "frequency", "monetary")


def rfm_base(transactions: DataFrame, *, customer: str = "customer_id",
             ts: str = "transaction_timestamp", txn_id: str = "transaction_id",
             amount: str = "amount", status: str = "status", completed="Completed",
             money_scale: int | None = 2) -> DataFrame:
    """customer, recency_days, frequency, monetary over completed rows.

    A NULL customer forms one group of its own, as in SQL GROUP BY. The
    transactions are read once, when this is called: the per-customer totals are
    checkpointed and the reference date is observed on the way.
    """
    totals, latest = _written(_customer_totals(transactions, customer, ts, txn_id, amount, status,
                                               completed, money_scale))
    return _with_recency(totals, customer, latest)


def rfm_scores(base: DataFrame, *, customer: str = "customer_id", tiles: int = 4,
               materialize: bool = False) -> DataFrame:
    """Adds r_score, f_score, m_score (1..tiles, NTILE semantics); customer ids
    must be unique, as ``rfm_base`` leaves them.

    The quartiles read ``base`` several times: it should be a cheap projection
    of a checkpoint, as ``rfm_base`` returns it. ``materialize=True`` checkpoints
    any other frame first.
    """
    require_columns(base, customer, "recency_days", "frequency", "monetary")
    frame = base
    if materialize:
        ensure_checkpoint_dir(base.sparkSession)
        frame = base.checkpoint(eager=True)
    keys = {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"),
            "m_score": F.col("monetary")}
    return (ntile_columns(frame, customer, keys, tiles)
            .select(customer, "recency_days", "frequency", "monetary", *keys))


def rfm_label(scores: DataFrame) -> DataFrame:
    """Adds total_rfm_score and rfm_segment; the first matching rule wins."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = (F.when((r == 4) & (f == 4) & (m == 4), F.lit(CHAMPIONS))
               .when((r >= 3) & (f >= 3), F.lit(LOYAL))
               .when((r >= 3) & (f <= 2), F.lit(PROMISING))
               .when((r <= 2) & (f >= 3), F.lit(AT_RISK))
               .otherwise(F.lit(CHURNED)))
    return scores.withColumn("total_rfm_score", (r + f + m).cast("long")) \
                 .withColumn("rfm_segment", segment)


def rfm_customers(transactions: DataFrame, *, customer: str = "customer_id",
                  ts: str = "transaction_timestamp", txn_id: str = "transaction_id",
                  amount: str = "amount", status: str = "status", completed="Completed",
                  money_scale: int | None = 2, tiles: int = 4) -> DataFrame:
    """Per-customer scores and labels.

    The transactions are read once (``rfm_base``).
    """
    base = rfm_base(transactions, customer=customer, ts=ts, txn_id=txn_id, amount=amount,
                    status=status, completed=completed, money_scale=money_scale)
    return rfm_label(rfm_scores(base, customer=customer, tiles=tiles))


def rfm_segments(labelled: DataFrame, *, customer: str = "customer_id",
                 money_scale: int | None = 2, ordered: bool = True) -> DataFrame:
    """Segment summary: customer_count (non-NULL ids), average recency and
    frequency (1 place), average and total monetary (2 places), by revenue."""
    sums = labelled.groupBy("rfm_segment").agg(
        F.count(customer).alias("customer_count"),
        F.avg("recency_days").alias("_recency"),
        F.avg("frequency").alias("_frequency"),
        money_sum(labelled, "monetary", money_scale).alias("_money"),
        F.count("monetary").alias("_priced"))
    out = sums.select(
        "rfm_segment", "customer_count",
        round_sql("_recency", 1).alias("avg_recency_days"),
        round_sql("_frequency", 1).alias("avg_frequency"),
        round_sql(F.col("_money") / F.nullif(F.col("_priced"), F.lit(0)), 2).alias("avg_monetary_spend"),
        round_sql("_money", 2).alias("total_segment_revenue"))
    # At most five rows, one per segment label.
    return sort_bounded(out, F.col("total_segment_revenue").desc_nulls_last()) if ordered else out
