"""Exact distinct counts by bitmaps: against sets in plain Python."""

import random

import pytest

from tidemark.operators import (
    count_states,
    distinct_counts,
    distinct_rollup,
    distinct_states,
    merge_states,
)
from tidemark.plans.inspect import plan_text

EDGES = [0, 1, -1, 62, 63, 64, 65, -62, -63, -64, -65, 32767, 32768, -32768, -32769,
         2 ** 63 - 1, 2 ** 63 - 64, -2 ** 63, -2 ** 63 + 1]


@pytest.fixture(scope="module")
def visits():
    rng = random.Random(8)
    out = [("hot", d, rng.randrange(40000)) for d in range(3) for _ in range(400)]
    out += [("edge", d, i) for d, i in enumerate(EDGES)] + [("edge", 0, i) for i in EDGES]
    out += [("none", 0, None), ("none", 1, None), ("hot", 0, None), (None, 1, 5), (None, None, 5), (None, 2, 7)]
    return out + out[:50]


def counts(rows, key):
    seen = {}
    for r in rows:
        seen.setdefault(key(r), set()).update([] if r[2] is None else [r[2]])
    return {k: len(v) for k, v in seen.items()}


@pytest.mark.parametrize("kind", ["long", "string", "double", "decimal(20,0)"])
def test_counts_equal_sets_of_ids(spark, visits, kind):
    df = spark.createDataFrame(visits, "site string, day int, user long")
    df = df.withColumn("user", df.user.cast(kind))
    if kind == "double":     # several longs are one double
        visits = [(s, d, None if u is None else float(u)) for s, d, u in visits]
    got = {r.site: r.users for r in distinct_counts(df, ["site"], "user", "users").collect()}
    assert got == counts(visits, lambda r: r[0])
    assert [tuple(r) for r in distinct_counts(df, [], "user").collect()] == [(counts(visits, lambda r: 0)[0],)]


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
def test_every_integer_type_takes_the_bitmaps(spark, kind):
    df = spark.createDataFrame([(i % 7 - 3,) for i in range(30)], "user long")
    df = df.select(df.user.cast(kind))
    assert "_bits" in distinct_states(df, [], "user").columns
    assert distinct_counts(df, [], "user").collect()[0][0] == 7


@pytest.mark.parametrize("kind", ["long", "string"])
def test_levels_merge_from_the_finest(spark, visits, kind):
    df = spark.createDataFrame(visits, "site string, day int, user long")
    df = df.withColumn("user", df.user.cast(kind))
    got = {(r.level, r.day, r.site): r.n
           for r in distinct_rollup(df, [["day", "site"], ["site"], []], "user", "n").collect()}
    want = {(0, d, s): n for (s, d), n in counts(visits, lambda r: r[:2]).items()}
    want |= {(1, None, s): n for s, n in counts(visits, lambda r: r[0]).items()}
    assert got == want | {(2, None, None): counts(visits, lambda r: 0)[0]}


def test_states_written_and_merged_later(spark, visits, tmp_path):
    """A day's states are stored as they come; months need no rows again."""
    for day in range(3):
        df = spark.createDataFrame([v for v in visits if v[1] == day], "site string, day int, user long")
        distinct_states(df, ["site", "day"], "user").write.mode("append").parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    got = {r.site: r["count"] for r in count_states(merge_states(states, ["site"]), ["site"]).collect()}
    assert got == counts([v for v in visits if v[1] in (0, 1, 2)], lambda r: r[0])


def test_no_rows(spark):
    empty = spark.createDataFrame([], "site string, user long")
    assert distinct_counts(empty, ["site"], "user").collect() == []
    assert distinct_counts(empty, [], "user").collect()[0][0] == 0
    assert [tuple(r) for r in distinct_rollup(empty, [["site"], []], "user").collect()] == [(1, None, 0)]


def test_rows_combine_before_they_move(spark, visits):
    df = spark.createDataFrame(visits, "site string, day int, user long")
    text = plan_text(distinct_counts(df, ["site"], "user"))
    assert "partial_bit_or" in text and "partial_sum" in text
    assert "Expand" not in text and "Window" not in text and "Sort" not in text


def test_clashing_and_foreign_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "_bits int, level int, user long")
    with pytest.raises(ValueError, match="_bits"):
        distinct_states(df, ["_bits"], "user")
    with pytest.raises(ValueError, match="level"):
        distinct_rollup(df, [["level"], []], "user")
    with pytest.raises(ValueError, match="not among"):
        distinct_rollup(df.withColumn("a", df.user), [["a"], ["user"]], "user")
    with pytest.raises(ValueError, match="missing"):
        distinct_states(df, ["gone"], "user")
