"""

``entry(spark)`` runs the flagship report (the per-device ordered funnel) on
each over whole check tables mapped to the reference's data model
(``tidemark.sources.driver_tables``). ``oracle_sql()`` holds the same
computation in DuckDB SQL by another method where there is one: the funnel
event by event, the cohorts from each customer's list of months, RFM tiles from
row numbers over plain sums, the audit from filtered counts and anti joins.
"""

from __future__ import annotations

import datetime
import hashlib
import importlib
import os
import sys
import warnings
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators import (  # noqa: E402
    audit,
    business_rule_audit,
    cohort_counts,
    cohort_matrix,
    cohort_matrix_freq,
    cohort_retention,
    densify_stages,
    distinct_counts,
    distinct_rollup,
    event_mix,
    funnel_all,
    funnel_by_segment,
    funnel_rates,
    funnel_reach,
    funnel_segment,
    funnel_unordered,
    global_ntile,
    kpis,
    null_key_audit,
    orphan_audit,
    rfm_base,
    rfm_customers,
    rfm_scores,
    rfm_segments,
)
from tidemark.sources import driver_tables as dt  # noqa: E402
from tidemark.session import ensure_checkpoint_dir  # noqa: E402
from tidemark.sources.layout import Layout, read_laid_out, write_laid_out  # noqa: E402
from tidemark.sources.parquet import read_table, write_table  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _optional(name: str):
    """A module of the training-data subpackage, or the pipeline built on it;
    None, with a warning where it is installed, if it cannot be imported: the
    other queries do not depend on it."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        if not (isinstance(e, ModuleNotFoundError) and e.name and f"{name}.".startswith(f"{e.name}.")):
            warnings.warn(f"{name} is left out: {e}", stacklevel=2)
        return None


_llm = _optional("tidemark.llm.queries")
_pipeline = _optional("corpus_pipeline") if _llm else None


def _prepare(spark: SparkSession) -> None:
    # Operators that checkpoint ask for the checkpoint directory themselves.
    spark.conf.set("spark.sql.session.timeZone", "UTC")


# ------------------------------------------------------------------ funnel

def q_funnel_reach(spark, d):
    _prepare(spark)
    return funnel_reach(dt.events(spark, d), dt.STAGES)


def q_funnel_dense(spark, d):
    _prepare(spark)
    ev = dt.events(spark, d)
    return densify_stages(funnel_reach(ev, dt.STAGES), ev.select("device"), dt.STAGES)


def q_funnel_by_device(spark, d):
    _prepare(spark)
    return funnel_by_segment(dt.events(spark, d), dt.STAGES)


def q_funnel_rates(spark, d):
    _prepare(spark)
    ev = dt.events(spark, d)
    return funnel_rates(densify_stages(funnel_reach(ev, dt.STAGES), ev.select("device"), dt.STAGES))


def q_funnel_hot_sessions(spark, d):
    """The funnel with every session of two or more stage events on the join
    path that very large sessions take, and the others in their windows."""
    _prepare(spark)
    return funnel_by_segment(dt.events(spark, d), dt.STAGES, hot_session_rows=1)


def q_funnel_one_device(spark, d):
    _prepare(spark)
    return funnel_segment(funnel_by_segment(dt.events(spark, d), dt.STAGES, ordered=False),
                          "desktop")


def q_funnel_all(spark, d):
    _prepare(spark)
    return funnel_all(funnel_by_segment(dt.events(spark, d), dt.STAGES, ordered=False))


def q_funnel_unordered(spark, d):
    _prepare(spark)
    return funnel_unordered(read_table(spark, d, "events"), "event_type", "user_id",
                            list(dt.STAGES))


# ------------------------------------------------------------------ cohort

def q_cohort_retention(spark, d):
    _prepare(spark)
    return cohort_retention(dt.transactions(spark, d), ts="transaction_timestamp")


# Columns of the matrices: every offset of the check tables' calendar (orders
# 1995-01 to 2001-08, events 30 days). An offset outside the list raises.
OFFSETS = {"D": range(30), "W": range(5), "M": range(80), "Q": range(27), "Y": range(7),
           "W-SAT": range(5), "Q-APR": range(28), "Y-JUN": range(8)}


def q_cohort_matrix(spark, d):
    _prepare(spark)
    return cohort_matrix(cohort_retention(dt.transactions(spark, d), ts="transaction_timestamp",
                                          ordered=False), OFFSETS["M"])


_FREQ_SOURCES = {"events": ("user_id", "ts"), "orders": ("o_custkey", "o_orderdate")}


def _cohort_freq(source: str, freq: str):
    def run(spark, d):
        _prepare(spark)
        return cohort_matrix_freq(read_table(spark, d, source), *_FREQ_SOURCES[source], freq,
                                  OFFSETS[freq])
    return run


def _cohort_counts(source: str, freq: str):
    """The long form."""
    def run(spark, d):
        _prepare(spark)
        return cohort_counts(read_table(spark, d, source), *_FREQ_SOURCES[source], freq)
    return run


# ------------------------------------------------------------------ rfm

def _rfm_base(spark, d):
    return rfm_base(dt.transactions(spark, d), completed=dt.COMPLETED)


def q_rfm_base(spark, d):
    _prepare(spark)
    return _rfm_base(spark, d)


def q_rfm_scores(spark, d):
    _prepare(spark)
    return rfm_scores(_rfm_base(spark, d))


def q_global_ntile(spark, d):
    """Deciles of every order by amount (transaction id breaks ties)."""
    _prepare(spark)
    tx = dt.transactions(spark, d).select("transaction_id", "amount")
    return global_ntile(tx, [F.col("amount").asc_nulls_last(),
                             F.col("transaction_id").asc_nulls_last()],
                        10, "decile")


def q_rfm_customers(spark, d):
    _prepare(spark)
    return rfm_customers(dt.transactions(spark, d), completed=dt.COMPLETED)


def q_rfm_segments(spark, d):
    _prepare(spark)
    return rfm_segments(rfm_customers(dt.transactions(spark, d), completed=dt.COMPLETED))


# ------------------------------------------------------------------ audit

def _audit(spark, d, ordered=True):
    return audit(dt.audit_customers(spark, d), dt.audit_events(spark, d),
                 dt.audit_transactions(spark, d), ordered=ordered)


def q_dq_audit(spark, d):
    _prepare(spark)
    return _audit(spark, d)


def _dq_row(single_audit):
    def run(spark, d):
        _prepare(spark)
        return single_audit(dt.audit_customers(spark, d), dt.audit_events(spark, d),
                            dt.audit_transactions(spark, d))
    return run


# ------------------------------------------------------------------ overview

def q_kpis(spark, d):
    _prepare(spark)
    return kpis(dt.customers(spark, d), read_table(spark, d, "events"), dt.transactions(spark, d),
                completed=dt.COMPLETED)


def q_distinct_users(spark, d):
    """Distinct users of each event type."""
    _prepare(spark)
    return distinct_counts(read_table(spark, d, "events"), ["event_type"], "user_id", "users")


def q_distinct_rollup(spark, d):
    """Distinct users by day and event type, then by week, over all and in all."""
    _prepare(spark)
    events = read_table(spark, d, "events").withColumns({
        "day": F.to_date("ts"), "week": F.to_date(F.date_trunc("week", "ts"))})
    return distinct_rollup(events, [["day", "week", "event_type"], ["week", "event_type"],
                                    ["event_type"], []], "user_id", "users")


def q_event_mix(spark, d):
    _prepare(spark)
    return event_mix(read_table(spark, d, "events"))


# ------------------------------------------------------------------ tables

def _copies(spark: SparkSession, d: str) -> str:
    """The folder of a query's own table copies, in the shared checkpoint folder:
    one for each input, so that a later run replaces them."""
    return f"{ensure_checkpoint_dir(spark)}/copies-{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def q_table_write(spark, d):
    """The mapped events, written and read again."""
    _prepare(spark)
    base = f"{_copies(spark, d)}/plain"
    write_table(dt.events(spark, d), base, "events")
    return read_laid_out(spark, base, "events")


def q_table_laid_out(spark, d):
    """The mapped events from a copy bucketed by session and partitioned by date."""
    _prepare(spark)
    base = f"{_copies(spark, d)}/days"
    write_laid_out(dt.events(spark, d), base, "events",
                   Layout(bucket_by=["session_id"], buckets=4, sort_by=["session_id", "timestamp"],
                          day_of="timestamp"))
    return read_laid_out(spark, base, "events")


def q_funnel_bucketed(spark, d):
    """The funnel over a copy of the events bucketed by session: its windows run
    on the buckets."""
    _prepare(spark)
    base = f"{_copies(spark, d)}/buckets"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_laid_out(dt.events(spark, d), base, "events",
                   Layout(bucket_by=["session_id"], buckets=buckets, sort_by=["session_id"]))
    return funnel_by_segment(read_laid_out(spark, base, "events"), dt.STAGES, ordered=False)


def entry(spark: SparkSession) -> DataFrame:
    return q_funnel_by_device(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """
    training-data subpackage and pipeline where they are installed."""
    more = dict(_llm.QUERIES) if _llm else {}
    if _pipeline:
        more["pipeline"] = _pipeline.run
    return reference_queries() | more


def reference_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "funnel_reach": q_funnel_reach,
        "funnel_dense": q_funnel_dense,
        "funnel_by_device": q_funnel_by_device,
        "funnel_rates": q_funnel_rates,
        "funnel_hot_sessions": q_funnel_hot_sessions,
        "funnel_one_device": q_funnel_one_device,
        "funnel_all": q_funnel_all,
        "funnel_unordered": q_funnel_unordered,
        "cohort_retention": q_cohort_retention,
        "cohort_matrix": q_cohort_matrix,
        "cohort_freq_day": _cohort_freq("events", "D"),
        "cohort_freq_week": _cohort_freq("events", "W"),
        "cohort_freq_month": _cohort_freq("orders", "M"),
        "cohort_freq_quarter": _cohort_freq("orders", "Q"),
        "cohort_freq_year": _cohort_freq("orders", "Y"),
        "cohort_freq_week_sat": _cohort_freq("events", "W-SAT"),
        "cohort_freq_quarter_apr": _cohort_freq("orders", "Q-APR"),
        "cohort_freq_year_jun": _cohort_freq("orders", "Y-JUN"),
        "cohort_counts_hour": _cohort_counts("events", "H"),
        "cohort_counts_day": _cohort_counts("orders", "D"),
        "cohort_counts_week": _cohort_counts("orders", "W"),
        "rfm_base": q_rfm_base,
        "rfm_scores": q_rfm_scores,
        "global_ntile": q_global_ntile,
        "rfm_customers": q_rfm_customers,
        "rfm_segments": q_rfm_segments,
        "dq_nulls": _dq_row(null_key_audit),
        "dq_orphans": _dq_row(orphan_audit),
        "dq_rules": _dq_row(business_rule_audit),
        "dq_audit": q_dq_audit,
        "kpis": q_kpis,
        "distinct_users": q_distinct_users,
        "distinct_rollup": q_distinct_rollup,
        "event_mix": q_event_mix,
        "table_write": q_table_write,
        "table_laid_out": q_table_laid_out,
        "funnel_bucketed": q_funnel_bucketed,
    }


# ====================================================================== SQL
# DuckDB SQL over the pre-registered check tables. The mapped views are the
# same text as in tidemark.sources.driver_tables.

_EV = f"ev AS ({dt.EVENTS_SQL})"
_TX = f"tx AS ({dt.TRANSACTIONS_SQL})"

_STAGE_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(dt.STAGES, start=1))

# Event by event: a stage-k event counts when a counted stage-(k-1) event of its
# session is no later.
def _counted(k: int) -> str:
    earlier = f"""
    AND EXISTS (SELECT 1 FROM hit{k - 1} p WHERE p.session_id = ev.session_id
                AND p."timestamp" <= ev."timestamp")""" if k > 1 else ""
    return f"""hit{k} AS (
    SELECT session_id, customer_id, device, "timestamp" FROM ev
    WHERE event_type = '{dt.STAGES[k - 1]}'{earlier})"""


_K = range(1, len(dt.STAGES) + 1)
_HITS = ",\n".join(_counted(k) for k in _K)
_HIT_USERS = " UNION ALL ".join(f"SELECT device, {k} AS k, customer_id FROM hit{k}" for k in _K)
_NAMES = f"[{', '.join(repr(s) for s in dt.STAGES)}]"


def _per_stage(value: str, default: str = "0") -> str:
    """A list of one number for each stage, from rows of (k, ...)."""
    return "[" + ", ".join(f"coalesce({value} FILTER (k = {k}), {default})" for k in _K) + "]"


# Per device the list of its K user counts, and beside it the same list moved by
# one place; the rates are arithmetic on the two lists, place by place.
_FUNNEL_CTES = f"""{_EV},
{_HITS},
tally AS (SELECT device, k, COUNT(DISTINCT customer_id) AS n FROM ({_HIT_USERS}) h GROUP BY device, k),
counted AS (
    SELECT device, {_per_stage("max(n)")} AS users
    FROM (SELECT device, k, n FROM tally WHERE device IS NOT NULL
          UNION ALL SELECT DISTINCT device, 0, 0 FROM ev) t
    GROUP BY device),
funnel AS (
    SELECT device, CAST(k AS INTEGER) AS stage_order, {_NAMES}[k] AS funnel_stage, users[k] AS unique_users,
           ROUND(users[k] * 100.0 / NULLIF(users[1], 0), 2) AS overall_conversion_pct,
           ROUND(users[k] * 100.0 / NULLIF(list_prepend(users[1], users)[k], 0), 2) AS step_conversion_pct,
           ROUND(100.0 - users[k] * 100.0 / NULLIF(list_prepend(users[1], users)[k], 0), 2) AS dropoff_pct
    FROM counted, generate_series(1, {len(dt.STAGES)}) place(k))"""

_FUNNEL_ALL = f"""WITH {_FUNNEL_CTES},
summed AS (SELECT {_per_stage("sum(unique_users)", "NULL")} AS users
           FROM (SELECT stage_order AS k, unique_users FROM funnel) f),
shares AS (
    SELECT k, users[k] AS u, list_prepend(users[1], users)[k] AS prev, users[1] AS top,
           round_even(users[k] / NULLIF(list_prepend(users[1], users)[k], 0) * 100, 2) AS step
    FROM summed, generate_series(1, {len(dt.STAGES)}) place(k) WHERE users[k] IS NOT NULL)
SELECT CAST(k AS INTEGER) AS stage_order, {_NAMES}[k] AS funnel_stage, CAST(u AS BIGINT) AS unique_users,
       round_even(u / NULLIF(top, 0) * 100, 2) AS overall_conversion_pct,
       CAST(prev AS BIGINT) AS prev_users, step AS step_conversion_pct,
       round_even(100.0 - step, 2) AS dropoff_pct
FROM shares"""

_FUNNEL_UNORDERED = f"""
WITH stages AS (SELECT * FROM (VALUES {_STAGE_VALUES}) s(k, stage)),
c AS (SELECT s.k, s.stage, COUNT(DISTINCT e.user_id) AS users
      FROM stages s LEFT JOIN events e ON e.event_type = s.stage GROUP BY s.k, s.stage),
w AS (SELECT *, FIRST_VALUE(users) OVER (ORDER BY k) AS first_u, LAG(users) OVER (ORDER BY k) AS prev_u FROM c)
SELECT stage, users,
       round_even(users / (CASE WHEN first_u > 0 THEN first_u ELSE 1 END) * 100, 2) AS overall_conversion,
       round_even(users / NULLIF(COALESCE(prev_u, first_u), 0) * 100, 2) AS step_conversion,
       round_even(100 - round_even(users / NULLIF(COALESCE(prev_u, first_u), 0) * 100, 2), 2) AS dropoff_rate
FROM w"""

# Per customer the sorted list of active months, unnested against its first.
_COHORT_CTES = f"""{_TX},
months AS (
    SELECT list_sort(list_distinct(list(DATE_TRUNC('month', transaction_timestamp)))) AS active
    FROM tx WHERE customer_id IS NOT NULL AND transaction_timestamp IS NOT NULL GROUP BY customer_id),
starts AS (SELECT active[1] AS cohort_month, COUNT(*) AS n FROM months GROUP BY active[1]),
seen AS (SELECT active[1] AS cohort_month, unnest(active) AS month FROM months),
cohort AS (
    SELECT seen.cohort_month, any_value(starts.n) AS initial_cohort_size,
           DATEDIFF('month', seen.cohort_month, seen.month) AS period_offset,
           COUNT(*) AS active_users,
           ROUND(COUNT(*) * 100.0 / any_value(starts.n), 2) AS retention_rate_pct
    FROM seen JOIN starts ON starts.cohort_month = seen.cohort_month
    GROUP BY seen.cohort_month, seen.month)"""

_PERIOD_SQL = {
    "D": ("CAST({c} AS DATE)", "DATEDIFF('day', {a}, {b})", "strftime({c}, '%Y-%m-%d')"),
    "W": ("CAST(DATE_TRUNC('week', {c}) AS DATE)", "DATEDIFF('day', {a}, {b}) // 7",
          "strftime({c}, '%Y-%m-%d') || '/' || strftime({c} + INTERVAL 6 DAY, '%Y-%m-%d')"),
    "M": ("CAST(DATE_TRUNC('month', {c}) AS DATE)", "DATEDIFF('month', {a}, {b})",
          "strftime({c}, '%Y-%m')"),
    "Q": ("CAST(DATE_TRUNC('quarter', {c}) AS DATE)", "DATEDIFF('quarter', {a}, {b})",
          "CAST(year({c}) AS VARCHAR) || 'Q' || CAST(quarter({c}) AS VARCHAR)"),
    "Y": ("CAST(DATE_TRUNC('year', {c}) AS DATE)", "DATEDIFF('year', {a}, {b})",
          "CAST(year({c}) AS VARCHAR)"),
    "H": ("DATE_TRUNC('hour', {c})", "DATEDIFF('hour', {a}, {b})", "strftime({c}, '%Y-%m-%d %H:%M')"),
    # Weeks of Sunday to Saturday; quarters of years that end in April; years that end in June.
    "W-SAT": ("CAST(DATE_TRUNC('week', {c} + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE)",
              "DATEDIFF('day', {a}, {b}) // 7",
              "strftime({c}, '%Y-%m-%d') || '/' || strftime({c} + INTERVAL 6 DAY, '%Y-%m-%d')"),
    "Q-APR": ("CAST(DATE_TRUNC('quarter', DATE_TRUNC('month', {c}) - INTERVAL 1 MONTH) + INTERVAL 1 MONTH AS DATE)",
              "DATEDIFF('month', {a}, {b}) // 3",
              "CAST(year({c} + INTERVAL 8 MONTH) AS VARCHAR) || 'Q' || "
              "CAST(quarter({c} + INTERVAL 8 MONTH) AS VARCHAR)"),
    "Y-JUN": ("CAST(DATE_TRUNC('year', DATE_TRUNC('month', {c}) + INTERVAL 6 MONTH) - INTERVAL 6 MONTH AS DATE)",
              "DATEDIFF('month', {a}, {b}) // 12", "CAST(year({c} + INTERVAL 6 MONTH) AS VARCHAR)"),
}


def _cohort_long_ctes(table: str, user: str, ts: str, freq: str) -> str:
    """Per user the sorted list of active periods, unnested against its first."""
    start, diff, _ = _PERIOD_SQL[freq]
    return f"""lists AS (
    SELECT {user} AS u, list_sort(list_distinct(list({start.format(c=ts)}))) AS periods
    FROM {table} WHERE {user} IS NOT NULL AND {ts} IS NOT NULL GROUP BY {user}),
active AS (SELECT periods[1] AS cohort, unnest(periods) AS p FROM lists),
sizes AS (SELECT periods[1] AS cohort, COUNT(*) AS size FROM lists GROUP BY periods[1]),
long AS (
    SELECT a.cohort, {diff.format(a='a.cohort', b='a.p')} AS period_idx, COUNT(*) AS users,
           round_even(COUNT(*) / any_value(s.size), 4) * 100 AS retention
    FROM active a JOIN sizes s ON s.cohort = a.cohort GROUP BY a.cohort, a.p)"""


def _wide(label: str, cohort: str, offset: str, value: str, offsets, prefix: str = "") -> str:
    cells = ", ".join(f'max(CASE WHEN {offset} = {n} THEN {value} END) AS "{prefix}{n}"' for n in offsets)
    return f"{label} AS {cohort}, {cells}"


def _cohort_freq_sql(table: str, user: str, ts: str, freq: str) -> str:
    label = _PERIOD_SQL[freq][2].format(c="cohort")
    return f"""WITH {_cohort_long_ctes(table, user, ts, freq)}
SELECT {_wide(label, "cohort", "period_idx", "retention", OFFSETS[freq])}
FROM long GROUP BY long.cohort"""


# Per customer the plain sum of the amounts, in whole cents; tiles from each
# row's number and the row count, not from NTILE.
def _tile(order: str, n: int = 4) -> str:
    number = f"(row_number() OVER (ORDER BY {order}, customer_id ASC NULLS LAST) - 1)"
    size, extra = f"(count(*) OVER () // {n})", f"(count(*) OVER () % {n})"
    return (f"CASE WHEN {number} < {extra} * ({size} + 1) THEN {number} // ({size} + 1) + 1 "
            f"ELSE ({number} - {extra}) // {size} + 1 END")


_RFM_CTES = f"""{_TX},
spend AS (
    SELECT customer_id, arg_max(CAST(transaction_timestamp AS DATE), transaction_timestamp) AS seen,
           COUNT(transaction_id) AS frequency, ROUND(SUM(amount), 2) AS monetary
    FROM tx WHERE status = '{dt.COMPLETED}' GROUP BY customer_id),
base AS (
    SELECT customer_id, max(seen) OVER () - seen AS recency_days, frequency, monetary FROM spend),
scores AS (
    SELECT *, {_tile("recency_days DESC NULLS LAST")} AS r_score,
           {_tile("frequency ASC NULLS LAST")} AS f_score,
           {_tile("monetary ASC NULLS LAST")} AS m_score
    FROM base),
-- The label rules as a table: half of r, half of f, and all three at the top.
halves(recent, often, label) AS (
    VALUES (true, true, 'Loyal Customers'), (true, false, 'Promising / Recent'),
           (false, true, 'At Risk'), (false, false, 'Needs Attention / Churned')),
labelled AS (
    SELECT s.*, r_score + f_score + m_score AS total_rfm_score,
           if(r_score + f_score + m_score = 12, 'Champions', h.label) AS rfm_segment
    FROM scores s JOIN halves h ON h.recent = (r_score > 2) AND h.often = (f_score > 2))"""

# Each audit row from FILTER aggregates over one list of the tables' keys;
# orphans by ANTI JOIN, repeated ids as those a numbering reaches a second time.
_AUDIT_SOURCES = f"""c AS ({dt.AUDIT_CUSTOMERS_SQL}),
e AS ({dt.AUDIT_EVENTS_SQL}),
t AS ({dt.AUDIT_TRANSACTIONS_SQL})"""

_AUDIT_NULLS = """
SELECT 'Null Key Audit' AS audit_category,
       count(*) FILTER (src = 'c') AS missing_customer_ids,
       count(*) FILTER (src = 'e') AS missing_event_keys,
       count(*) FILTER (src = 't') AS missing_txn_keys
FROM (SELECT 'c' AS src, customer_id AS a, 0 AS b FROM c
      UNION ALL SELECT 'e', event_id, customer_id FROM e
      UNION ALL SELECT 't', transaction_id, customer_id FROM t) k
WHERE a IS NULL OR b IS NULL"""

_AUDIT_ORPHANS = """
SELECT 'Referential Integrity Audit' AS audit_category,
       count(*) FILTER (src = 'e') AS missing_customer_ids,
       count(*) FILTER (src = 't') AS missing_event_keys, 0 AS missing_txn_keys
FROM (SELECT DISTINCT 'e' AS src, customer_id FROM e WHERE customer_id IS NOT NULL
      UNION ALL SELECT DISTINCT 't', customer_id FROM t WHERE customer_id IS NOT NULL) o
ANTI JOIN c ON c.customer_id = o.customer_id"""

_AUDIT_RULES = """
SELECT 'Business Rule Audit' AS audit_category,
       count(*) FILTER (src = 't') AS missing_customer_ids,
       count(*) FILTER (src = 'e') AS missing_event_keys, 0 AS missing_txn_keys
FROM (SELECT 't' AS src FROM t WHERE amount <= 0
      UNION ALL
      SELECT 'e' FROM (SELECT row_number() OVER (PARTITION BY event_id) AS n FROM e) r WHERE n = 2) b"""


def _audit_sql(*parts: str) -> str:
    return f"WITH {_AUDIT_SOURCES} " + " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


def oracle_sql() -> dict[str, str]:
    """The same result in DuckDB SQL, for each key in ``queries()`` that SQL
    can express."""
    more = dict(_llm.ORACLE_SQL) if _llm else {}
    if _pipeline and _pipeline.ORACLE_SQL:
        more["pipeline"] = _pipeline.ORACLE_SQL
    return reference_oracles() | more


def reference_oracles() -> dict[str, str]:
    sql = {
        "funnel_reach": f"""WITH {_FUNNEL_CTES}
            SELECT device, k AS stage_order, {_NAMES}[k] AS funnel_stage, n AS unique_users FROM tally""",
        "funnel_dense": f"""WITH {_FUNNEL_CTES}
            SELECT device, stage_order, funnel_stage, unique_users FROM funnel""",
        "funnel_by_device": f"WITH {_FUNNEL_CTES} SELECT * FROM funnel ORDER BY device, stage_order",
        "funnel_rates": f"WITH {_FUNNEL_CTES} SELECT * FROM funnel",
        "funnel_hot_sessions": f"WITH {_FUNNEL_CTES} SELECT * FROM funnel",
        "funnel_one_device": f"WITH {_FUNNEL_CTES} SELECT * FROM funnel WHERE device = 'desktop'",
        "funnel_all": _FUNNEL_ALL,
        "funnel_unordered": _FUNNEL_UNORDERED,
        "cohort_retention": f"""WITH {_COHORT_CTES}
            SELECT * FROM cohort ORDER BY cohort_month, period_offset""",
        "cohort_matrix": f"""WITH {_COHORT_CTES}
            SELECT {_wide("strftime(cohort_month, '%Y-%m')", "cohort_month", "period_offset",
                          "retention_rate_pct", OFFSETS["M"], "Month ")}
            FROM cohort WHERE period_offset IS NOT NULL GROUP BY cohort.cohort_month""",
        "cohort_freq_day": _cohort_freq_sql("events", "user_id", "ts", "D"),
        "cohort_freq_week": _cohort_freq_sql("events", "user_id", "ts", "W"),
        "cohort_freq_month": _cohort_freq_sql("orders", "o_custkey", "o_orderdate", "M"),
        "cohort_freq_quarter": _cohort_freq_sql("orders", "o_custkey", "o_orderdate", "Q"),
        "cohort_freq_year": _cohort_freq_sql("orders", "o_custkey", "o_orderdate", "Y"),
        "cohort_freq_week_sat": _cohort_freq_sql("events", "user_id", "ts", "W-SAT"),
        "cohort_freq_quarter_apr": _cohort_freq_sql("orders", "o_custkey", "o_orderdate", "Q-APR"),
        "cohort_freq_year_jun": _cohort_freq_sql("orders", "o_custkey", "o_orderdate", "Y-JUN"),
        "cohort_counts_hour": f"""WITH {_cohort_long_ctes("events", "user_id", "ts", "H")}
            SELECT * FROM long""",
        "cohort_counts_day": f"""WITH {_cohort_long_ctes("orders", "o_custkey", "o_orderdate", "D")}
            SELECT * FROM long""",
        "cohort_counts_week": f"""WITH {_cohort_long_ctes("orders", "o_custkey", "o_orderdate", "W")}
            SELECT * FROM long""",
        "rfm_base": f"WITH {_RFM_CTES} SELECT * FROM base",
        "rfm_scores": f"WITH {_RFM_CTES} SELECT * FROM scores",
        "global_ntile": f"""WITH {_TX}
            SELECT transaction_id, amount,
                   NTILE(10) OVER (ORDER BY amount ASC NULLS LAST, transaction_id ASC NULLS LAST) AS decile
            FROM tx""",
        "rfm_customers": f"WITH {_RFM_CTES} SELECT * FROM labelled",
        "rfm_segments": f"""WITH {_RFM_CTES}
            SELECT rfm_segment,
                   COUNT(customer_id) AS customer_count,
                   ROUND(AVG(recency_days), 1) AS avg_recency_days,
                   ROUND(AVG(frequency), 1) AS avg_frequency,
                   ROUND(SUM(monetary) / NULLIF(COUNT(monetary), 0), 2) AS avg_monetary_spend,
                   ROUND(SUM(monetary), 2) AS total_segment_revenue
            FROM labelled GROUP BY rfm_segment ORDER BY total_segment_revenue DESC""",
        "dq_audit": _audit_sql(_AUDIT_NULLS, _AUDIT_ORPHANS, _AUDIT_RULES),
        "dq_nulls": _audit_sql(_AUDIT_NULLS),
        "dq_orphans": _audit_sql(_AUDIT_ORPHANS),
        "dq_rules": _audit_sql(_AUDIT_RULES),
        "kpis": f"""
            SELECT (SELECT COUNT(DISTINCT c_custkey) FROM customer) AS total_customers,
                   (SELECT COUNT(*) FROM events) AS total_events,
                   (SELECT COUNT(*) FROM orders WHERE o_orderstatus = '{dt.COMPLETED}') AS total_orders,
                   (SELECT ROUND(SUM(o_totalprice), 2) FROM orders WHERE o_orderstatus = '{dt.COMPLETED}') AS total_revenue""",
        "table_write": f"WITH {_EV} SELECT * FROM ev",
        "table_laid_out": f"WITH {_EV} SELECT * FROM ev",
        "funnel_bucketed": f"WITH {_FUNNEL_CTES} SELECT * FROM funnel",
        "distinct_users": """SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events
            GROUP BY event_type""",
        "distinct_rollup": """
            WITH e AS (SELECT *, CAST(ts AS DATE) AS day, CAST(date_trunc('week', ts) AS DATE) AS week FROM events)
            SELECT CAST(CASE GROUPING(day, week, event_type) WHEN 0 THEN 0 WHEN 4 THEN 1 WHEN 6 THEN 2 ELSE 3 END
                        AS INTEGER) AS level,
                   day, week, event_type, COUNT(DISTINCT user_id) AS users
            FROM e GROUP BY GROUPING SETS ((day, week, event_type), (week, event_type), (event_type), ())""",
        "event_mix": """SELECT event_type, COUNT(*) AS count FROM events
                        GROUP BY event_type ORDER BY count DESC""",
    }
    return sql
