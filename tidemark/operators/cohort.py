"""Cohort retention.

* ``cohort_retention``   - long form by first-activity month (the reference's
  cohort report): cohort_month, initial_cohort_size, period_offset,
  active_users, retention_rate_pct.
* ``cohort_matrix``      - that long form pivoted to ``YYYY-MM`` rows and
  ``Month n`` columns.
* ``cohort_matrix_freq`` - retention matrix at any frequency from seconds to
  years, values = share of the cohort, rounded to 4 places, x100.

Plan shape: one aggregate by user gathers the set of the user's periods, with
map-side partial aggregation, so any hot user shrinks to one row a task, with a
set bounded by the calendar, before the only exchange of user rows. The cohort is
the set's least period; the sets are unnested where they are and counted by one
``groupBy(cohort, period)``, again combined map-side. The cohort size is the offset-0 count of the
same small result, so no second pass over events is needed. The matrices
checkpoint that small long form once, then read their column list (one
offset per calendar period) and pivot from it, so events are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import pct_of, require_columns
from tidemark.functions.periods import month_start, period_index, period_label, period_start
from tidemark.functions.rounding import round_even, round_sql
from tidemark.session import ensure_checkpoint_dir


def _user_periods(df: DataFrame, user: str, period, undated: bool = False) -> DataFrame:
    """(_c, _p): each user's first period beside each distinct one. With
    ``undated`` a user's NULL times count as one more period, NULL."""
    sets = (df.select(F.col(user).alias("_u"), period.alias("_p"))
            .where(F.col("_u").isNotNull())
            .groupBy("_u").agg(F.collect_set("_p").alias("_set"),
                               F.bool_or(F.col("_p").isNull()).alias("_undated"))
            .where(F.size("_set") > 0))
    periods = F.col("_set")
    if undated:
        periods = F.when(F.col("_undated"), F.array_append(periods, F.lit(None))).otherwise(periods)
    return sets.select(F.array_min("_set").alias("_c"), F.explode(periods).alias("_p"))


def cohort_retention(events: DataFrame, *, user: str = "customer_id",
                     ts: str = "timestamp", ordered: bool = True) -> DataFrame:
    """Monthly cohort retention in long form.

    A user's cohort is the month of their earliest event of any type. Only
    months with activity get a row. A user with some NULL times adds to a row
    with NULL ``period_offset``; users with no time at all, and NULL users,
    are left out.
    """
    require_columns(events, user, ts)
    pairs = _user_periods(events, user, month_start(F.col(ts)), undated=True)
    counts = (pairs.groupBy(F.col("_c").alias("cohort_month"), F.col("_p").alias("_month"))
              .agg(F.count(F.lit(1)).alias("active_users")))
    offset = (period_index(F.col("_month"), "month")
              - period_index(F.col("cohort_month"), "month"))
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active_users"))).over(
        Window.partitionBy("cohort_month"))
    out = (counts.withColumn("period_offset", offset)
           .withColumn("initial_cohort_size", size)
           .withColumn("_pct", pct_of(F.col("active_users"), F.col("initial_cohort_size")))
           .select("cohort_month", "initial_cohort_size", "period_offset", "active_users",
                   round_sql("_pct", 2).alias("retention_rate_pct")))
    if ordered:
        out = out.orderBy("cohort_month", F.col("period_offset").asc_nulls_last())
    return out


def _observed_offsets(long: DataFrame, offset_col: str) -> tuple[DataFrame, list[int]]:
    """The cohort result checkpointed, and its distinct offsets.

    The long form is small (cohorts x offsets) but costs a full pass over the
    events; checkpointing it means that pass runs once for both the offsets
    (at most one per calendar period, collected) and the pivot.
    """
    ensure_checkpoint_dir(long.sparkSession)
    frozen = long.checkpoint(eager=True)
    offsets = sorted(r[0] for r in frozen.select(offset_col).where(F.col(offset_col).isNotNull())
                     .distinct().collect())
    return frozen, offsets


def _listed(col: str, offsets: Sequence[int]):
    """Whether the offset has a column; an offset outside the list is an error,
    so that no cell is left out without a word."""
    known = F.col(col).isin(list(offsets))
    return F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit(f"{col} outside the given offsets: "), F.col(col).cast("string"))).cast("boolean"))


def cohort_matrix(long: DataFrame, offsets: Sequence[int] | None = None) -> DataFrame:
    """Pivot ``cohort_retention`` output: ``cohort_month`` as ``YYYY-MM`` text,
    one ``Month n`` column per offset, NULL where a cohort had no activity.

    ``offsets`` fixes the columns (an observed offset outside them raises when
    the query runs); by default they are the observed offsets. Rows with a NULL offset have no column and are left out.
    """
    known = long.where(F.col("period_offset").isNotNull())
    if offsets is None:
        known, offsets = _observed_offsets(known, "period_offset")
    else:
        known = known.where(_listed("period_offset", offsets))
    offsets = [int(o) for o in offsets]
    wide = (known
            .groupBy(F.date_format("cohort_month", "yyyy-MM").alias("cohort_month"))
            .pivot("period_offset", offsets)
            .agg(F.first("retention_rate_pct")))
    return (wide.select("cohort_month", *[F.col(f"`{o}`").alias(f"Month {o}") for o in offsets])
            .orderBy("cohort_month"))


def cohort_counts(df: DataFrame, user: str, ts: str, freq: str = "M") -> DataFrame:
    """Long form behind ``cohort_matrix_freq``: cohort (first day of the
    period), period_idx, users, retention (share of the cohort, round 4, x100)."""
    require_columns(df, user, ts)
    pairs = _user_periods(df, user, period_start(F.col(ts), freq))
    counts = pairs.groupBy("_c", "_p").agg(F.count(F.lit(1)).alias("users"))
    idx = period_index(F.col("_p"), freq) - period_index(F.col("_c"), freq)
    size = F.max(F.when(F.col("period_idx") == 0, F.col("users"))).over(Window.partitionBy("_c"))
    return (counts.withColumn("period_idx", idx)
            .withColumn("_size", size)
            .select(F.col("_c").alias("cohort"), "period_idx", "users",
                    (round_even(F.col("users") / F.nullif(F.col("_size"), F.lit(0)), 4)
                     * F.lit(100.0)).alias("retention")))


def cohort_matrix_freq(df: DataFrame, user_col: str, date_col: str, freq: str = "ME",
                       offsets: Sequence[int] | None = None) -> DataFrame:
    """Retention matrix at any frequency of ``functions.periods`` (s, min, h, D,
    W and W-SAT, M/ME, Q and Q-MAR, Y and Y-JUN).

    Rows are cohorts labelled as pandas prints the period (``2026-01``,
    ``2026Q1``, ``2026``, ``2026-01-05/2026-01-11``, ``2026-01-10``), in
    time order; columns ``0..n`` are periods since the cohort; values are
    ``round(users / cohort size, 4) * 100``, NULL where nobody was active.
    Weeks run Monday to Sunday unless anchored. ``date_col`` may be a timestamp, date or ISO
    text column.
    """
    long = cohort_counts(df, user_col, date_col, freq)
    if offsets is None:
        long, offsets = _observed_offsets(long, "period_idx")
    else:
        long = long.where(_listed("period_idx", offsets))
    offsets = [int(o) for o in offsets]
    wide = (long.groupBy("cohort").pivot("period_idx", offsets).agg(F.first("retention")))
    return (wide.orderBy("cohort")
            .select(period_label(F.col("cohort"), freq).alias("cohort"),
                    *[F.col(f"`{o}`") for o in offsets]))
