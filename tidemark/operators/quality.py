"""Data-quality audit over customers, events and transactions.

Three rows, four columns, named as the reference names them (the first audit
names every column):

=============================  =====================  ====================  ================
audit_category                 missing_customer_ids   missing_event_keys    missing_txn_keys
=============================  =====================  ====================  ================
Null Key Audit                 customers, NULL id     events, NULL event    transactions, NULL
                                                      or customer id        txn or customer id
Referential Integrity Audit    distinct event         distinct transaction  0
                               customers not in       customers not in
                               customers              customers
Business Rule Audit            amounts <= 0           event ids seen more   0
                                                      than once
=============================  =====================  ====================  ================

Plan shape: each table is read once. Its rows become keyed rows of one tagged
union: customers, events and transactions by customer id, events by event id
as well. One ``groupBy`` of that union counts, per key, the rows of each table and
their defects; a customer id with event rows and no customer row is an orphan,
an event id with two rows a duplicate, and one aggregate of these counts is the
whole audit. There is one exchange, no join and no window; every count is
combined map-side first, so a NULL or repeated id holding a third of the rows
leaves one row a task. NULL ids in the customer table never hide orphans (NOT
EXISTS semantics, not NOT IN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import require_columns, sort_bounded

# Audit row labels of the reference (fixed values).
NULL_KEYS = "Null Key Audit"
REFERENCES = "Referential Integrity Audit"
RULES = "Business Rule Audit"
AUDIT_COLUMNS = ("audit_category", "missing_customer_ids", "missing_event_keys", "missing_txn_keys")


def _name(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _key_counts(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
                customer: str, event_id: str | None = None, txn_id: str | None = None,
                amount: str | None = None) -> DataFrame:
    """One row for each customer id, and event id if asked for: the table rows
    that have it (``_c``, ``_e``, ``_t``, ``_ids``), and those with a missing key
    or a bad amount."""
    id_type = dict(customers.dtypes)[customer]
    event_type = dict(events.dtypes)[event_id] if event_id else "int"
    none = {"_kind": "0", "_id": "NULL", "_event": "NULL", "_c": "0", "_e": "0", "_t": "0",
            "_missing": "0", "_bad": "0", "_ids": "0"}

    def row(**values: str) -> list[str]:
        values = none | values
        values |= {"_id": f"CAST({values['_id']} AS {id_type})",
                   "_event": f"CAST({values['_event']} AS {event_type})"}
        return [f"{v} AS {k}" for k, v in values.items()]

    def missing(*keys: str | None) -> str:
        return f"int({' OR '.join(f'{_name(k)} IS NULL' for k in keys if k)})"

    own = _name(customer)
    event_row = row(_id=own, _e="1", _missing=missing(customer, event_id))
    if event_id:        # an event row counts under its customer and under its own id
        id_row = row(_kind="1", _event=_name(event_id), _ids="1")
        event_row = [f"inline(array(struct({', '.join(event_row)}), struct({', '.join(id_row)})))"]
    bad = f"int(coalesce({_name(amount)} <= 0, false))" if amount else "0"
    every = (customers.selectExpr(*row(_id=own, _c="1"))
             .unionByName(events.selectExpr(*event_row))
             .unionByName(transactions.selectExpr(
                 *row(_id=own, _t="1", _bad=bad, _missing=missing(customer, txn_id)))))
    return every.groupBy("_kind", "_id", "_event").agg(*map(F.expr, (
        "sum(_c) AS _c", "sum(_e) AS _e", "sum(_t) AS _t", "sum(_ids) AS _ids", "sum(_bad) AS _bad",
        "sum(_e * _missing) AS _e_missing", "sum(_t * _missing) AS _t_missing")))


# Distinct non-NULL ids of events and of transactions without a customer row.
_ORPHANS = {"event_orphans": "count_if(_id IS NOT NULL AND _c = 0 AND _e > 0)",
            "txn_orphans": "count_if(_id IS NOT NULL AND _c = 0 AND _t > 0)"}


def audit(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
          customer: str = "customer_id", event_id: str = "event_id",
          txn_id: str = "transaction_id", amount: str = "amount",
          ordered: bool = True) -> DataFrame:
    """The three-row audit table, rows in the order above."""
    require_columns(customers, customer)
    require_columns(events, event_id, customer)
    require_columns(transactions, txn_id, customer, amount)
    counts = _key_counts(customers, events, transactions, customer=customer, event_id=event_id,
                         txn_id=txn_id, amount=amount)

    figures = _ORPHANS | {
        "customers": "coalesce(sum(CASE WHEN _kind = 0 AND _id IS NULL THEN _c END), 0L)",
        "events": "coalesce(sum(_e_missing), 0L)", "txns": "coalesce(sum(_t_missing), 0L)",
        "bad": "coalesce(sum(_bad), 0L)", "repeated": "count_if(_ids > 1)"}
    one = counts.agg(*[F.expr(f"{sql} AS {name}") for name, sql in figures.items()])

    def row(order: int, label: str, *cells: str) -> str:
        return (f"struct({order} AS _row, '{label}' AS {AUDIT_COLUMNS[0]}, "
                + ", ".join(f"CAST({c} AS BIGINT) AS {n}" for c, n in zip(cells, AUDIT_COLUMNS[1:])) + ")")

    rows = [row(1, NULL_KEYS, "customers", "events", "txns"),
            row(2, REFERENCES, "event_orphans", "txn_orphans", "0"),
            row(3, RULES, "bad", "repeated", "0")]
    out = one.selectExpr(f"inline(array({', '.join(rows)}))")
    return (sort_bounded(out, "_row") if ordered else out).select(*AUDIT_COLUMNS)


def _audit_row(one: DataFrame, label: str, *figures: Column) -> DataFrame:
    """One audit row over a one-row frame; unused cells are 0."""
    cells = [*figures, F.lit(0), F.lit(0)][:3]
    return one.select(F.lit(label).alias(AUDIT_COLUMNS[0]),
                      *[c.cast("long").alias(n) for c, n in zip(cells, AUDIT_COLUMNS[1:])])


def null_key_audit(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
                   customer: str = "customer_id", event_id: str = "event_id",
                   txn_id: str = "transaction_id") -> DataFrame:
    """The null-key row alone: a count over each table, no exchange of ids."""
    def missing(df: DataFrame, *keys: str) -> DataFrame:
        require_columns(df, *keys)
        null = F.col(keys[0]).isNull()
        for k in keys[1:]:
            null = null | F.col(k).isNull()
        return df.agg(F.count_if(null).alias("_n"))

    return _audit_row(missing(customers, customer), NULL_KEYS, F.col("_n"),
                      missing(events, event_id, customer).scalar(),
                      missing(transactions, txn_id, customer).scalar())


def orphan_audit(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
                 customer: str = "customer_id") -> DataFrame:
    """The reference row alone: the tables' customer ids counted together."""
    for df in (customers, events, transactions):
        require_columns(df, customer)
    one = (_key_counts(customers, events, transactions, customer=customer)
           .agg(*[F.expr(f"{sql} AS {name}") for name, sql in _ORPHANS.items()]))
    return _audit_row(one, REFERENCES, *map(F.col, _ORPHANS))


def business_rule_audit(customers: DataFrame, events: DataFrame, transactions: DataFrame, *,
                        event_id: str = "event_id", amount: str = "amount") -> DataFrame:
    """The rule row alone: a count of amounts and the repeated event ids."""
    require_columns(events, event_id)
    require_columns(transactions, amount)
    repeated = (events.groupBy(event_id).agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.count_if(F.col("_n") > 1)))
    bad = transactions.agg(F.count_if(F.col(amount) <= F.lit(0)).alias("_bad"))
    return _audit_row(bad, RULES, F.col("_bad"), repeated.scalar())
