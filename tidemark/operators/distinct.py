"""Exact distinct counts from states that merge.

The state of a group holds the ids seen in it: for ids of an integer type as
bitmaps, one word for each range of 64 ids that occurs (a row a range), for ids of
any other type as the distinct ids themselves. States of finer groups (days) merge
into those of coarser ones (weeks, all) without another look at the rows, which
counts alone cannot do.

Words are combined by ``bit_or``, a hash aggregate within generated code, partially in
the map tasks: ids lying close together, as running numbers do, cross the network
as one row for up to 64 of them, scattered ids as a row each, like a plain dedup.
Spark's own bitmap aggregates hold 32,768 ids in 4 kB, sort all rows for it, and
shuffle several times what a dedup does where ids are scattered.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.functions.columns import require_columns
from tidemark.session import ensure_checkpoint_dir

RANGE, BITS, ID = "_range", "_bits", "_id"


def distinct_states(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The state of each group of the columns ``by``. NULL ids are not counted,
    but a group of NULL ids alone keeps a row, so that it counts 0."""
    require_columns(df, *by, value)
    if clash := {RANGE, BITS, ID} & set(by):
        raise ValueError(f"columns {sorted(clash)} are those of the state")
    v = F.col(value)
    if not isinstance(df.schema[value].dataType, IntegralType):
        return df.select(*by, v.alias(ID)).distinct()
    v = v.cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))
    return (df.select(*by, F.shiftright(v, 6).alias(RANGE), bit.alias(BITS))
            .groupBy(*by, RANGE).agg(F.bit_or(BITS).alias(BITS)))


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The states of coarser groups: ``by`` is a part of the states' columns."""
    require_columns(states, *by)
    if ID in states.columns:
        return states.select(*by, ID).distinct()
    return states.groupBy(*by, RANGE).agg(F.bit_or(BITS).alias(BITS))


def count_states(states: DataFrame, by: Sequence[str], name: str = "count") -> DataFrame:
    """The number of distinct ids in each group; ``by`` are all the states' groups."""
    if ID in states.columns:
        return states.groupBy(*by).agg(F.count(ID).alias(name))
    ids = F.coalesce(F.sum(F.bit_count(BITS)), F.lit(0)).cast("long")
    return states.groupBy(*by).agg(ids.alias(name))


def distinct_counts(df: DataFrame, by: Sequence[str], value: str, name: str = "count") -> DataFrame:
    """``count(DISTINCT value)`` for each group of ``by``; one row if there are none."""
    return count_states(distinct_states(df, by, value), by, name)


def distinct_rollup(df: DataFrame, levels: Sequence[Sequence[str]], value: str,
                    name: str = "count") -> DataFrame:
    """Distinct ids of each group at several levels: ``level`` (0 is the first, the
    finest, whose columns hold those of all others), its columns, NULL where a
    level does not group by them, and the count.

    One scan builds the finest states, which are checkpointed; the other levels
    merge them. Grouping sets would shuffle each row once for every level.
    """
    finest = list(levels[0])
    if foreign := [c for by in levels for c in by if c not in finest]:
        raise ValueError(f"columns {foreign} are not among the first level's")
    if "level" in finest:
        raise ValueError("a column is named level")
    ensure_checkpoint_dir(df.sparkSession)
    states = distinct_states(df, finest, value).checkpoint()
    types = {c: states.schema[c].dataType for c in finest}

    def counted(level: int, by: Sequence[str]) -> DataFrame:
        merged = states if list(by) == finest else merge_states(states, by)
        return count_states(merged, by, name).select(
            F.lit(level).alias("level"),
            *[F.col(c) if c in by else F.lit(None).cast(types[c]).alias(c) for c in finest], name)

    return reduce(DataFrame.unionByName, [counted(i, by) for i, by in enumerate(levels)])
