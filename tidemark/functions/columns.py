"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    """Fail early, with the missing names, when a frame lacks input columns."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing input columns {missing}; frame has {df.columns}")


def pct_of(part: Column, whole: Column) -> Column:
    """``part * 100.0 / whole`` as a double; NULL when ``whole`` is 0 or NULL.

    The multiplication comes first, as in the reference's SQL. Dividing by
    ``nullif`` keeps ANSI mode from raising on a zero divisor.
    """
    return (part * F.lit(100.0)) / F.nullif(whole, F.lit(0))


def ratio_pct(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` as a double (the pandas order of operations); NULL on 0."""
    return (part / F.nullif(whole, F.lit(0))) * F.lit(100.0)


def stage_index(col: Column, stages: Iterable[str]) -> Column:
    """1-based position of ``col`` in the literal stage list, 0 when absent."""
    return F.array_position(F.array(*[F.lit(s) for s in stages]), col).cast("int")


def money_sum(df: DataFrame, name: str, scale: int | None = 2) -> Column:
    """``sum`` of an amount column, as a double: an aggregate expression.

    Plain ``SUM`` semantics (NaN and infinities included). Where every amount
    of the group is the double nearest to a decimal of ``scale`` places (cents),
    the sum is taken over those decimals, so it is exact and does not depend on
    task order; any other amount in the group (sub-cent, widened float32, NaN,
    infinite, beyond ``decimal(38)``) gives the plain double sum.
    ``scale=None`` always gives the plain sum. Integer and decimal columns are
    exact as they are.
    """
    col = F.col(name)
    if scale is None or dict(df.dtypes)[name] not in ("double", "float"):
        return F.sum(col).cast("double")
    amount = col.cast("double")
    money = amount.try_cast(f"decimal(38,{scale})")
    inexact = amount.isNotNull() & ~money.cast("double").eqNullSafe(amount)
    exact = F.when(~F.bool_or(inexact), F.try_sum(money).cast("double"))
    return F.coalesce(exact, F.sum(amount))


def sort_bounded(df: DataFrame, *order) -> DataFrame:
    """Final ordering of a result whose row count has a fixed bound (one row per
    stage, per segment label): one task sorts it, with no sampling job and
    no range exchange. Results that grow with the data use ``orderBy``."""
    return df.coalesce(1).sortWithinPartitions(*order)
