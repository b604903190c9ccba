"""Cohort retention: long form, month matrix, any-frequency matrix."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import EVENT_SCHEMA, at, event
from tidemark.operators import cohort_counts, cohort_matrix, cohort_matrix_freq, cohort_retention
from tidemark.functions.periods import period_index, period_label, period_start

# Active days of each reader; "" is an event without a time.
READERS = {"flo": "2023-10-31 2023-11-01 2024-01-09 2024-01-30", "gus": "2023-10-02 2024-01-31",
           "hal": "2023-10-15", "ivy": "2023-12-24 2024-01-01 2024-02-29", "jon": "2023-12-31 2024-02-01"}


@pytest.fixture(scope="module")
def reading(spark):
    days = [(user, day) for user, text in READERS.items() for day in text.split()]
    return spark.createDataFrame(
        [event(f"r{n}", user, f"s{n}", at("21:15", day), "page_view") for n, (user, day) in enumerate(days)],
        EVENT_SCHEMA)


def test_every_row_of_the_readers(reading):                   # E14: months without activity have none
    out = cohort_retention(reading)
    assert [f.dataType.simpleString() for f in out.schema] == \
        ["timestamp_ntz", "bigint", "bigint", "bigint", "double"]
    assert [(r["cohort_month"].strftime("%Y-%m"), *tuple(r)[1:]) for r in out.collect()] == [
        ("2023-10", 3, 0, 3, 100.0), ("2023-10", 3, 1, 1, 33.33), ("2023-10", 3, 3, 2, 66.67),
        ("2023-12", 2, 0, 2, 100.0), ("2023-12", 2, 1, 1, 50.0), ("2023-12", 2, 2, 2, 100.0)]


def test_first_event_of_any_type_and_missing_values(spark):   # E13, E15, E16
    rows = [event("r1", "kai", "s", at("08:00", "2024-03-30"), "refund"),
            event("r2", "kai", "s", at("08:00", "2024-04-01"), "page_view"),
            event("r3", "kai", "s", None, "page_view"), event("r4", "lea", "s", None, "refund"),
            event("r5", None, "s", at("08:00", "2024-02-01"), "page_view")]
    out = cohort_retention(spark.createDataFrame(rows, EVENT_SCHEMA)).collect()
    assert [(r["cohort_month"].month, *tuple(r)[1:4]) for r in out] == \
        [(3, 1, 0, 1), (3, 1, 1, 1), (3, 1, None, 1)]


def test_month_matrix(reading):
    out = cohort_matrix(cohort_retention(reading, ordered=False))
    assert out.columns == ["cohort_month", "Month 0", "Month 1", "Month 2", "Month 3"]
    assert [tuple(r) for r in out.collect()] == [
        ("2023-10", 100.0, 33.33, None, 66.67), ("2023-12", 100.0, 50.0, 100.0, None)]


def test_offsets_given_fix_the_columns_or_raise(reading):
    long = cohort_retention(reading, ordered=False)
    assert cohort_matrix(long, range(5)).columns[-1] == "Month 4"
    with pytest.raises(Exception, match="outside the given offsets"):
        cohort_matrix(long, range(3)).collect()


def test_matrix_of_dates_as_text(spark):
    days = [(u, d) for u, text in READERS.items() for d in text.split()]
    df = spark.createDataFrame(days, "who string, day string")
    out = cohort_matrix_freq(df, "who", "day", "Q")
    assert [tuple(r) for r in out.collect()] == [("2023Q4", 100.0, 80.0)]
    assert out.columns == ["cohort", "0", "1"]


ANCHORED = ["W-WED", "W-SAT", "Q-JAN", "Q-MAR", "Q-APR", "Q-DEC", "Y-JUN", "Y-FEB"]


@pytest.mark.parametrize("freq", ["s", "min", "h", "D", "W", "M", "Q", "Y", *ANCHORED])
def test_periods_equal_those_of_pandas(spark, freq):
    rnd = random.Random(5)
    times = [datetime(1968, 2, 27) + timedelta(seconds=rnd.randint(0, 60 * 366 * 86400)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(times)), "i int, t timestamp_ntz")
    start = period_start(F.col("t"), freq)
    got = df.select("i", period_label(start, freq).alias("label"),
                    period_index(start, freq).alias("n")).orderBy("i").collect()
    want = [pd.Period(t, freq) for t in times]
    assert [r["label"] for r in got] == [str(p) for p in want]
    assert [r["n"] - got[0]["n"] for r in got] == [p.ordinal - want[0].ordinal for p in want]


@pytest.mark.parametrize("freq", ["B", "2M", "W-ABC", "M-JAN", "QS-MAR", ""])
def test_unknown_frequency_is_rejected(spark, freq):
    data = spark.createDataFrame([(1, at("07:00"))], "u long, t timestamp_ntz")
    with pytest.raises(ValueError):
        cohort_matrix_freq(data, "u", "t", freq)


# ------------------------------------------------------------ brute force

def _period(d: date, freq: str):
    """(first day, index) of the period holding d."""
    if freq == "D":
        return d, d.toordinal()
    if freq == "W":
        start = d - timedelta(days=d.weekday())
        return start, start.toordinal() // 7
    if freq == "M":
        return date(d.year, d.month, 1), d.year * 12 + d.month
    if freq == "Q":
        q = (d.month - 1) // 3
        return date(d.year, 3 * q + 1, 1), d.year * 4 + q
    return date(d.year, 1, 1), d.year


def _brute_matrix(pairs, freq):
    seen = {}
    for user, when in pairs:
        if user is None or when is None:
            continue
        seen.setdefault(user, set()).add(_period(when.date(), freq))
    counts = {}
    for periods in seen.values():
        first = min(periods)
        for p in periods:
            counts[(first, p[1] - first[1])] = counts.get((first, p[1] - first[1]), 0) + 1
    out = {}
    for (cohort, idx), n in counts.items():
        size = counts[(cohort, 0)]
        out[(cohort[0], idx)] = float(np.round(n / size, 4) * 100)
    return out


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_matrix_equals_brute_force(spark, freq):
    rnd = random.Random(7)
    start = datetime(2023, 11, 20)
    pairs = [(rnd.choice([None] + list(range(60))),
              None if rnd.random() < 0.03 else start + timedelta(hours=rnd.randint(0, 24 * 500)))
             for _ in range(1500)]
    df = spark.createDataFrame(pairs, "u long, t timestamp_ntz")
    got = {(r["cohort"], r["period_idx"]): r["retention"]
           for r in cohort_counts(df, "u", "t", freq).collect()}
    assert got == _brute_matrix(pairs, freq)
    wide = cohort_matrix_freq(df, "u", "t", freq)
    cells = sum(1 for r in wide.collect() for c in wide.columns[1:] if r[c] is not None)
    assert cells == len(got)
