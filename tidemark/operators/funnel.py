"""Conversion funnels.

Ordered funnel (per session, stage k counts when it happens at or after the
earliest qualifying stage k-1 event of the same session):

* ``funnel_reach``    - distinct users per (segment, stage) that some event reached.
* ``densify_stages``  - every (segment, stage) pair, 0 where nobody got there.
* ``funnel_rates``    - overall / step / drop-off percentages per segment.
* ``funnel_by_segment`` - the three above, the reference's funnel report.
* ``funnel_all``      - all segments summed per stage, rates recomputed.
* ``funnel_segment``  - one segment of a funnel.

Unordered funnel: ``funnel_unordered`` (distinct users per stage, no session
or order rule).

Plan shape of the ordered funnel (why it scales)
------------------------------------------------
The reference joins every stage's events to all earlier groups of the same
session. Here each stage k>=2 needs only one number per session, the
threshold ``T(k-1)`` = earliest qualifying time of stage k-1, because an event
qualifies iff its time is >= the minimum of the earlier group minima:

    T1 = min time of the session's stage-1 events
    Tk = min time of its stage-k events with time >= T(k-1)

and the counts are distinct (segment, stage, user) over qualifying events.

* One scan reads every stage event (five columns, one pushed ``IN`` filter)
  and one shuffle by session feeds a chain of ``min`` windows, one per
  threshold: no join, no fan-out, no pass per stage.
* Hot sessions (a bot may hold a third of all events) would make one window
  task hold all of it. They are found from a random sample of the stage events:
  at a rate that gives a session of ``hot_session_rows`` rows ``SAMPLE_ROWS``
  sample rows on average, the sessions with half as many are listed, the
  hottest ``HOT_SESSIONS`` at most. A session of ``hot_session_rows`` rows is
  missed with a probability below 1e-12 (Poisson tail), unless ``HOT_SESSIONS``
  others are as hot; a missed one costs time, never rows, since both ways give
  the same counts. Only sample rows are shuffled.
* The hot sessions' rows leave by a semi join and take a join path: per stage,
  a join to the previous thresholds, one row per hot session. The list and the
  thresholds are broadcast, which their bound of ``HOT_SESSIONS`` rows allows at
  every size, so hot rows stay in the tasks that read them and no task ever
  holds a hot session. They are checkpointed once, so that the passes per stage
  read them and not the whole events table. Where no hot session is found there
  is no join at all.
* A NULL session (often the largest "group") never enters a window: it
  counts at stage 1 only, as in the reference. Those rows come from a second
  scan whose ``session IS NULL`` and ``event_type = <stage 1>`` filters reach
  Parquet, so it skips every row group without NULL sessions.
* Every count-distinct is a dedup with map-side partial aggregation, so hot
  users or segments collapse before the shuffle.
* On a table bucketed by session the windows need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import (
    pct_of,
    ratio_pct,
    require_columns,
    sort_bounded,
    stage_index,
)
from tidemark.functions.rounding import round_even, round_sql
from tidemark.session import ensure_checkpoint_dir

# Stage list of the reference's funnel report (fixed values).
DEFAULT_STAGES = ("page_view", "product_view", "add_to_cart", "checkout_start", "purchase")


def _check_stages(stages: Sequence[str]) -> list[str]:
    stages = list(stages)
    if not stages:
        raise ValueError("a funnel needs at least one stage")
    if len(set(stages)) != len(stages):
        raise ValueError(f"funnel stages must be distinct: {stages}")
    return stages


def _stage_name(order_col, stages: Sequence[str]):
    return F.element_at(F.array(*[F.lit(s) for s in stages]), order_col)


# A session is "hot" when it holds more stage events than one window task
# should hold on its own.
HOT_SESSION_ROWS = 1_000_000
# Sample rows expected of a session at that limit; half of them make it hot.
SAMPLE_ROWS = 200
# The list of hot sessions and their thresholds are broadcast: at most this many
# rows, some 10 MB.
HOT_SESSIONS = 100_000


def _hot_sessions(rows: DataFrame, floor: int, seed: int = 20) -> DataFrame | None:
    """(_s) of the hottest sessions, those with ``floor`` stage events or more
    among them; checkpointed, since the split reads them twice. None: there are none."""
    rate = min(1.0, SAMPLE_ROWS / max(floor, 1))
    least = max(2, min(floor, SAMPLE_ROWS) // 2) if rate < 1 else floor + 1
    sample = rows.select("_s") if rate == 1 else rows.select("_s").where(F.rand(seed) < rate)
    hot = sample.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    if hot.isEmpty():
        return None
    ensure_checkpoint_dir(rows.sparkSession)
    return hot.orderBy(F.col("_n").desc()).limit(HOT_SESSIONS).select("_s").checkpoint(eager=True)


def _windowed_reach(rows: DataFrame, n_stages: int) -> DataFrame:
    """Reached stage rows of ordinary sessions: one shuffle by session, then a
    chain of ``min`` windows, threshold k from threshold k-1. Each window group
    is one session, bounded because hot sessions are routed elsewhere."""
    reached = ["stage_order = 1"]
    for k in range(1, n_stages):
        counts = f"stage_order = {k}" + (f" AND _t >= _T{k - 1}" if k > 1 else "")
        rows = rows.selectExpr("*", f"min(CASE WHEN {counts} THEN _t END) OVER (PARTITION BY _s) AS _T{k}")
        reached.append(f"(stage_order = {k + 1} AND _t >= _T{k})")
    return rows.where(" OR ".join(reached)).select("_d", "stage_order", "_u")


def _joined_reach(rows: DataFrame, n_stages: int) -> DataFrame:
    """Reached stage rows of hot sessions: per stage, a join to the previous
    stage's thresholds, one row per hot session."""
    reached, threshold = [], None
    for k in range(1, n_stages + 1):
        stage_rows = rows.where(F.col("stage_order") == k)
        if threshold is not None:
            stage_rows = (stage_rows.join(F.broadcast(threshold), "_s")   # <= HOT_SESSIONS rows
                          .where(F.col("_t") >= F.col("_prev")))
        reached.append(stage_rows.select("_d", "stage_order", "_u"))
        if k < n_stages:
            threshold = stage_rows.groupBy("_s").agg(F.min("_t").alias("_prev"))
    out = reached[0]
    for part in reached[1:]:
        out = out.unionByName(part)
    return out


def _stage_users(events: DataFrame, stages: Sequence[str], session: str, user: str,
                 segment: str, ts: str, event_type: str,
                 hot_session_rows: int | None) -> DataFrame:
    """(_d, stage_order, _u) for every event that reached its stage.

    Stage 1: every stage-1 event. Stage k: stage-k events of a session at or
    after that session's threshold ``T(k-1)`` = earliest qualifying stage k-1
    time. NULL sessions count at stage 1 only; sessions found to have
    ``hot_session_rows`` stage events or more take the join path, the others a
    window per session (``hot_session_rows=None``, for tables known to have no
    such session, saves the look for them).
    """
    require_columns(events, session, user, segment, ts, event_type)
    keyed = (events.where(F.col(event_type).isin(list(stages)) & F.col(session).isNotNull())
             .select(F.col(session).alias("_s"), F.col(user).alias("_u"),
                     F.col(segment).alias("_d"), F.col(ts).alias("_t"),
                     stage_index(F.col(event_type), stages).alias("stage_order")))
    # NULL sessions count at stage 1 only. Their own scan pushes
    # ``session IS NULL`` and ``event_type = <stage 1>`` to Parquet, so row
    # groups without NULL sessions are skipped on their statistics.
    no_session = (events.where(F.col(session).isNull() & (F.col(event_type) == F.lit(stages[0])))
                  .select(F.col(segment).alias("_d"), F.lit(1).alias("stage_order"),
                          F.col(user).alias("_u")))
    if hot_session_rows is None or len(stages) == 1:      # one stage: no window
        return _windowed_reach(keyed, len(stages)).unionByName(no_session)
    hot = _hot_sessions(keyed, hot_session_rows)
    if hot is None:
        return _windowed_reach(keyed, len(stages)).unionByName(no_session)
    hot = F.broadcast(hot)                                  # <= HOT_SESSIONS rows
    hot_rows = keyed.join(hot, "_s", "left_semi").checkpoint(eager=True)
    return (_windowed_reach(keyed.join(hot, "_s", "left_anti"), len(stages))
            .unionByName(_joined_reach(hot_rows, len(stages)))
            .unionByName(no_session))


def funnel_reach(events: DataFrame, stages: Sequence[str] = DEFAULT_STAGES, *,
                 session: str = "session_id", user: str = "customer_id",
                 segment: str = "device", ts: str = "timestamp",
                 event_type: str = "event_type",
                 hot_session_rows: int | None = HOT_SESSION_ROWS) -> DataFrame:
    """Distinct users per (segment, stage) in an ordered session funnel.

    Returns ``segment, stage_order, funnel_stage, unique_users`` with a row
    only where some event reached the stage (0 when all had NULL users). The
    user and segment counted at stage k are those of the stage-k event itself;
    sessions alone link the stages. Equal timestamps qualify. NULL users never
    count; NULL sessions and NULL times count at stage 1 only.
    """
    stages = _check_stages(stages)
    counts = (_stage_users(events, stages, session, user, segment, ts, event_type,
                           hot_session_rows)
              .groupBy("_d", "stage_order")
              .agg(F.count_distinct("_u").alias("unique_users")))
    return counts.select(
        F.col("_d").alias(segment), "stage_order",
        _stage_name(F.col("stage_order"), stages).alias("funnel_stage"), "unique_users")


def densify_stages(reach: DataFrame, segments: DataFrame,
                   stages: Sequence[str] = DEFAULT_STAGES, *, segment: str = "device") -> DataFrame:
    """Every (segment, stage) pair with its user count, 0 where absent.

    ``segments`` is a one-column frame of segment values (duplicates allowed).
    As in the reference's left join on ``=``, a NULL segment is kept but never
    matched, so its rows are all 0. Each segment is expanded over the literal
    stage list with ``explode`` (no join), then one aggregate merges counts.
    """
    stages = _check_stages(stages)
    stage_structs = F.array(*[
        F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("funnel_stage"))
        for i, s in enumerate(stages, start=1)])
    zeros = (segments.select(F.col(segment)).distinct()
             .select(F.col(segment), F.explode(stage_structs).alias("_st"))
             .select(segment, "_st.stage_order", "_st.funnel_stage",
                     F.lit(0).cast("long").alias("unique_users")))
    counted = reach.where(F.col(segment).isNotNull()).select(
        segment, "stage_order", "funnel_stage", F.col("unique_users").cast("long"))
    return (zeros.unionByName(counted)
            .groupBy(segment, "stage_order", "funnel_stage")
            .agg(F.sum("unique_users").alias("unique_users")))


def funnel_rates(dense: DataFrame, *, segment: str = "device") -> DataFrame:
    """Overall, step and drop-off percentages per segment (SQL rounding).

    overall = users / first stage; step = users / previous stage (the first
    stage is its own previous); drop-off = 100 - step, rounded from the
    unrounded step. A zero divisor gives NULL. Windows are per segment, so each
    window group has exactly one row per stage.
    """
    w = Window.partitionBy(segment).orderBy("stage_order")
    users = F.col("unique_users")
    top = F.first(users).over(w)
    step = pct_of(users, F.coalesce(F.lag(users).over(w), users))
    return (dense.select(segment, "stage_order", "funnel_stage", "unique_users",
                         pct_of(users, top).alias("_o"), step.alias("_p"))
            .select(segment, "stage_order", "funnel_stage", "unique_users",
                    round_sql("_o", 2).alias("overall_conversion_pct"),
                    round_sql("_p", 2).alias("step_conversion_pct"),
                    (F.lit(100.0) - F.col("_p")).alias("_q"))
            .select(segment, "stage_order", "funnel_stage", "unique_users",
                    "overall_conversion_pct", "step_conversion_pct",
                    round_sql("_q", 2).alias("dropoff_pct")))


def _rate_rows(stages: Sequence[str]):
    """Array of one struct per stage with the SQL-rounded rates, over the
    columns ``_c{k}`` (users), ``_o{k}`` (overall %) and ``_p{k}`` (step %)."""
    rows = []
    for k, stage in enumerate(stages, start=1):
        rows.append(F.struct(
            F.lit(k).alias("stage_order"), F.lit(stage).alias("funnel_stage"),
            F.col(f"_c{k}").alias("unique_users"),
            round_sql(f"_o{k}", 2).alias("overall_conversion_pct"),
            round_sql(f"_p{k}", 2).alias("step_conversion_pct"),
            round_sql(f"_q{k}", 2).alias("dropoff_pct")))
    return F.array(*rows)


def funnel_by_segment(events: DataFrame, stages: Sequence[str] = DEFAULT_STAGES, *,
                      session: str = "session_id", user: str = "customer_id",
                      segment: str = "device", ts: str = "timestamp",
                      event_type: str = "event_type", ordered: bool = True,
                      hot_session_rows: int | None = HOT_SESSION_ROWS) -> DataFrame:
    """The reference's funnel report: for every segment seen in any event (not
    only stage events), every stage with unique_users and the three rates;
    ordered by segment, stage.

    Same result as ``funnel_rates(densify_stages(funnel_reach(...)))`` in one
    pass after the stage chain: (segment, stage, user) triples and the segment
    list are deduplicated together, then one aggregate per segment counts the
    users of each stage and the rates are column arithmetic on that row.
    """
    stages = _check_stages(stages)
    reached = _stage_users(events, stages, session, user, segment, ts, event_type,
                           hot_session_rows)
    every_segment = events.select(F.col(segment).alias("_d"), F.lit(0).alias("stage_order"),
                                  F.lit(None).cast(reached.schema["_u"].dataType).alias("_u"))
    distinct = reached.unionByName(every_segment).distinct()
    known = F.col("_d").isNotNull()  # a NULL segment never matches: all zeros
    counts = [F.count_if(known & (F.col("stage_order") == k) & F.col("_u").isNotNull())
              .alias(f"_c{k}") for k in range(1, len(stages) + 1)]
    per_segment = distinct.groupBy("_d").agg(*counts)
    # Unrounded percentages once, as named columns; rounding reads them by name.
    cols = [F.col(f"_c{k}") for k in range(1, len(stages) + 1)]
    pcts = []
    for k, users in enumerate(cols, start=1):
        step = pct_of(users, cols[k - 2] if k > 1 else users)
        pcts += [pct_of(users, cols[0]).alias(f"_o{k}"), step.alias(f"_p{k}"),
                 (F.lit(100.0) - step).alias(f"_q{k}")]
    out = (per_segment.select("_d", *cols, *pcts)
           .select(F.col("_d").alias(segment), F.inline(_rate_rows(stages))))
    return out.orderBy(F.col(segment).asc_nulls_last(), "stage_order") if ordered else out


def funnel_segment(funnel: DataFrame, value, *, segment: str = "device") -> DataFrame:
    """Rows of one segment (the report's device filter)."""
    return funnel.where(F.col(segment) == F.lit(value))


def funnel_all(funnel: DataFrame, *, ordered: bool = True) -> DataFrame:
    """All segments together: users summed per stage (a user seen in two
    segments counts twice, as in the reference), rates recomputed with pandas
    conventions: divide then multiply, half-even rounding, drop-off taken from
    the rounded step. The window spans one row per stage."""
    per_stage = (funnel.groupBy("stage_order", "funnel_stage")
                 .agg(F.sum("unique_users").alias("unique_users")))
    w = Window.orderBy("stage_order")
    users = F.col("unique_users")
    top = F.first(users).over(w)
    prev = F.coalesce(F.lag(users).over(w), top)
    out = (per_stage
           .withColumn("prev_users", prev)
           .withColumn("overall_conversion_pct", round_even(ratio_pct(users, top), 2))
           .withColumn("step_conversion_pct", round_even(ratio_pct(users, F.col("prev_users")), 2))
           .withColumn("dropoff_pct", round_even(F.lit(100.0) - F.col("step_conversion_pct"), 2))
           .select("stage_order", "funnel_stage", "unique_users", "overall_conversion_pct",
                   "prev_users", "step_conversion_pct", "dropoff_pct"))
    return sort_bounded(out, "stage_order") if ordered else out      # one row per stage


def funnel_unordered(df: DataFrame, stage_col: str, user_col: str,
                     stage_order: Sequence[str]) -> DataFrame:
    """Distinct users per stage with conversion rates; no session or time rule.

    Returns ``stage, users, overall_conversion, step_conversion, dropoff_rate``
    in stage order, one row per entry of ``stage_order`` (a repeated stage has
    its users on each of its rows). The top divisor is the first stage's users,
    or 1 when that is 0; the first stage's previous is itself; a zero previous
    gives NULL. Rates are pandas-rounded (half to even).
    """
    listed_stages = list(stage_order)
    stages = _check_stages(list(dict.fromkeys(listed_stages)))
    require_columns(df, stage_col, user_col)
    spark = df.sparkSession
    idx = stage_index(F.col(stage_col), stages)
    counts = (df.where(F.col(stage_col).isin(stages))
              .select(idx.alias("_k"), F.col(user_col).alias("_u"))
              .groupBy("_k").agg(F.count_distinct("_u").alias("users")))
    # The stage list itself is the inline relation that makes empty stages 0:
    # one row per entry, with the index its stage is counted under.
    listed = spark.createDataFrame(
        [(i, stages.index(s) + 1) for i, s in enumerate(listed_stages, start=1)],
        "_place int, _k int")
    per_stage = (listed.join(F.broadcast(counts), "_k", "left")   # one row per distinct stage
                 .select(F.col("_place").alias("_k"),
                         F.coalesce("users", F.lit(0)).cast("long").alias("users")))
    w = Window.orderBy("_k")
    users = F.col("users")
    first = F.first(users).over(w)
    top = F.when(first > 0, first).otherwise(F.lit(1))
    prev = F.coalesce(F.lag(users).over(w), first)
    return (per_stage
            .withColumn("overall_conversion", round_even(ratio_pct(users, top), 2))
            .withColumn("step_conversion", round_even(ratio_pct(users, prev), 2))
            .withColumn("dropoff_rate", round_even(F.lit(100.0) - F.col("step_conversion"), 2))
            .transform(lambda df: sort_bounded(df, "_k"))                  # one row per stage
            .select(_stage_name(F.col("_k"), listed_stages).alias("stage"), "users",
                    "overall_conversion", "step_conversion", "dropoff_rate"))
