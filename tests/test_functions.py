"""Scalar functions: rounding conventions and calendar periods."""

import random
from datetime import date

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import period_index, period_start, round_even, round_sql


def test_round_sql_equals_duckdb_round(spark):
    rnd = random.Random(3)
    values = [1.005, 0.285, 2.5, -2.5, 0.125, -0.125, 1e17, float("inf"), 0.0, -0.0,
              66.66666666666667, 33.333333333333336]
    values += [rnd.randint(0, 20000) / rnd.randint(1, 3000) * 100 for _ in range(400)]
    values += [rnd.uniform(-1000, 1000) for _ in range(200)]
    # decimal half-way cases (x.xx5, x.x5) over magnitudes, both signs
    values += [sign * (n + 0.5) / 10 ** p for n in range(0, 2000, 7) for p in (1, 2, 3)
               for sign in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    out = df.select(round_sql(F.col("x"), 2).alias("a"), round_sql(F.col("x"), 1).alias("b"),
                    round_sql("x", 2).alias("c"), round_sql("x", 1).alias("d")).collect()
    got = [(r["a"], r["b"]) for r in out]
    assert [(r["c"], r["d"]) for r in out] == got          # by-name SQL form, same values
    con = duckdb.connect()
    want = con.execute("SELECT round(x, 2), round(x, 1) FROM (SELECT unnest(?::DOUBLE[]) AS x)",
                       [values]).fetchall()
    assert got == [tuple(w) for w in want]
    assert round_sql is not None and got[0][0] == 1.0     # not 1.01


def test_round_sql_nulls_and_nan(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    out = [r[0] for r in df.select(round_sql(F.col("x"), 2)).collect()]
    assert out[0] is None and out[1] != out[1]


def test_round_even_equals_numpy(spark):
    rnd = random.Random(5)
    values = [0.125, 0.375, 2.5, 3.5, -2.5] + [rnd.randint(0, 3000) / rnd.randint(1, 3000)
                                               for _ in range(500)]
    values += [sign * (n + 0.5) / 10 ** p for n in range(0, 3000, 11) for p in (2, 4)
               for sign in (1, -1)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(round_even(F.col("x"), 2).alias("a"), round_even(F.col("x"), 4).alias("b"),
                    round_even("x", 2).alias("c")).collect()
    assert [r["a"] for r in got] == [float(np.round(v, 2)) for v in values]
    assert [r["c"] for r in got] == [r["a"] for r in got]
    assert [r["b"] for r in got] == [float(np.round(v, 4)) for v in values]


def test_periods(spark):
    days = [date(2025, 12, 31), date(2026, 1, 1), date(2026, 1, 4), date(2026, 1, 5), date(2026, 4, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    cols = []
    for f in ("D", "W", "M", "Q", "Y"):
        cols += [period_start(F.col("d"), f).alias(f"s{f}"), period_index(period_start(F.col("d"), f), f).alias(f"i{f}")]
    rows = df.select(*cols).collect()
    assert [r["sW"] for r in rows] == [date(2025, 12, 29), date(2025, 12, 29), date(2025, 12, 29),
                                       date(2026, 1, 5), date(2026, 3, 30)]
    assert [r["iW"] - rows[0]["iW"] for r in rows] == [0, 0, 0, 1, 13]
    assert [r["iM"] - rows[0]["iM"] for r in rows] == [0, 1, 1, 1, 4]
    assert [r["iQ"] - rows[0]["iQ"] for r in rows] == [0, 1, 1, 1, 2]
    assert [r["iY"] - rows[0]["iY"] for r in rows] == [0, 1, 1, 1, 1]
    assert [r["iD"] - rows[0]["iD"] for r in rows] == [0, 1, 4, 5, 91]
    assert [r["sQ"] for r in rows][-1] == date(2026, 4, 1)
