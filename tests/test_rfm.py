"""RFM scoring, money sums and the distributed NTILEs."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import TXN_SCHEMA, at
from tidemark.operators import (
    global_ntile,
    kpis,
    ntile_columns,
    ntile_of_rank,
    rfm_base,
    rfm_customers,
    rfm_label,
    rfm_scores,
    rfm_segments,
)
from tidemark.operators.ntile import rows_at_ranks
from tidemark.plans.inspect import plan_text


def _txns(spark, rows):
    """(customer, day or None, amount, status) rows."""
    return spark.createDataFrame(
        [(f"x{i}", c, d and at("10:30", d), a, "Cash", s) for i, (c, d, a, s) in enumerate(rows)],
        TXN_SCHEMA)


def _paid(customer, last_day, amount, times=1):
    return [(customer, last_day, amount, "Completed")] * times


@pytest.fixture(scope="module")
def bakery(spark):
    """Six customers: tiles of 2, 2, 1 and 1."""
    return _txns(spark, _paid("kim", "2024-11-30", 40.0, 5) + _paid("lou", "2024-11-20", 10.5, 3)
                 + _paid("max", "2024-11-29", 99.99) + _paid("ned", "2024-06-30", 5.25, 4)
                 + _paid("oda", "2024-05-01", 7.0) + _paid("pam", "2024-11-25", 12.25, 2))


def test_scores_and_labels_of_each_customer(bakery):          # E17, E21, E22
    got = {r["customer_id"]: tuple(r)[1:] for r in rfm_customers(bakery).collect()}
    assert got == {
        "kim": (0, 5, 200.0, 4, 4, 4, 12, "Champions"),
        "lou": (10, 3, 31.5, 2, 2, 2, 6, "Needs Attention / Churned"),
        "max": (1, 1, 99.99, 3, 1, 3, 7, "Promising / Recent"),
        "ned": (153, 4, 21.0, 1, 3, 1, 5, "At Risk"),
        "oda": (213, 1, 7.0, 1, 1, 1, 3, "Needs Attention / Churned"),
        "pam": (5, 2, 24.5, 2, 2, 2, 6, "Needs Attention / Churned")}


def test_segment_summary_by_revenue(bakery):
    assert [tuple(r) for r in rfm_segments(rfm_customers(bakery)).collect()] == [
        ("Champions", 1, 0.0, 5.0, 200.0, 200.0),
        ("Promising / Recent", 1, 1.0, 1.0, 99.99, 99.99),
        ("Needs Attention / Churned", 3, 76.0, 2.0, 21.0, 63.0),
        ("At Risk", 1, 153.0, 4.0, 21.0, 21.0)]


def test_reruns_and_partitionings_agree_on_ties(spark):
    rnd = random.Random(23)
    df = _txns(spark, [row for c in range(90) for row in _paid(
        f"c{c}", rnd.choice(["2024-03-01", "2024-03-02"]), rnd.choice([2.5, 5.0]), rnd.randint(1, 2))])
    runs = [sorted(tuple(r) for r in rfm_customers(df.repartition(p)).collect())
            for p in (1, 3, 3, 11)]
    assert runs[1:] == runs[:1] * 3


def test_scores_move_no_customer_row(spark, bakery):
    scored = rfm_scores(rfm_base(bakery))
    text = plan_text(scored)
    assert "Exchange" not in text and "Window" not in text and "SinglePartition" not in text


def test_status_decides_which_rows_count(spark):              # E18
    df = _txns(spark, [("ria", "2024-04-01", 30.0, "Completed"), ("ria", "2024-04-09", 70.0, "Failed"),
                       ("sam", "2024-04-08", 15.0, "Refunded")])
    assert [tuple(r) for r in rfm_base(df).collect()] == [("ria", 0, 1, 30.0)]


def test_recency_counts_calendar_days(spark):                 # E17, F3
    rows = [("x1", "tom", at("23:50", "2024-04-01"), 1.0, "Cash", "Completed"),
            ("x2", "uma", at("00:10", "2024-04-02"), 1.0, "Cash", "Completed")]
    df = spark.createDataFrame(rows, TXN_SCHEMA)
    assert {r["customer_id"]: r["recency_days"] for r in rfm_base(df).collect()} == {"tom": 1, "uma": 0}


def test_null_customer_is_ranked_but_not_counted(spark):      # E19
    df = _txns(spark, _paid(None, "2024-04-02", 9.0) + _paid("vic", "2024-04-02", 4.0))
    out = rfm_segments(rfm_customers(df)).collect()
    assert sum(r["customer_count"] for r in out) == 1
    assert sum(r["total_segment_revenue"] for r in out) == 13.0


def test_missing_money_and_time_rank_last(spark):             # E20
    df = _txns(spark, _paid("a", "2024-04-02", None) + _paid("b", None, 1.0)
               + _paid("c", "2024-04-03", 2.0) + _paid("d", "2024-04-04", 3.0))
    got = {r["customer_id"]: (r["r_score"], r["m_score"]) for r in rfm_customers(df).collect()}
    assert got == {"a": (1, 4), "b": (4, 1), "c": (2, 2), "d": (3, 3)}


def test_label_rules(spark):                                  # E22
    scores = [(r, f, m) for r in (1, 2, 3, 4) for f in (1, 2, 3, 4) for m in (1, 4)]
    df = spark.createDataFrame(scores, "r_score long, f_score long, m_score long")
    for row in rfm_label(df).collect():
        r, f, m = row["r_score"], row["f_score"], row["m_score"]
        if r + f + m == 12:
            want = "Champions"
        elif r > 2:
            want = "Loyal Customers" if f > 2 else "Promising / Recent"
        else:
            want = "At Risk" if f > 2 else "Needs Attention / Churned"
        assert row["rfm_segment"] == want and row["total_rfm_score"] == r + f + m


# ------------------------------------------------------------ money

def _money(spark, amounts):
    df = _txns(spark, [row for a in amounts for row in _paid("w", "2024-04-02", a)])
    return rfm_base(df).collect()[0]["monetary"], kpis(
        spark.createDataFrame([("w",)], "customer_id string"), df, df).collect()[0]["total_revenue"]


def test_cents_are_summed_exactly(spark):
    assert _money(spark, [0.1] * 10) == (1.0, 1.0)


def test_sub_cent_amounts_are_not_rounded_away(spark):
    assert _money(spark, [0.004, 0.004]) == (0.008, 0.01)


def test_widened_float32_amounts_keep_their_plain_sum(spark):
    import numpy as np
    amounts = [float(np.float32(19.99)), float(np.float32(0.3))]
    assert _money(spark, amounts)[0] == sum(amounts)


def test_nan_and_infinity_sum_as_doubles_do(spark):
    assert all(math.isnan(v) for v in _money(spark, [float("nan"), 5.0]))
    assert _money(spark, [float("inf"), 5.0])[0] == math.inf
    assert _money(spark, [None, None]) == (None, None)


def test_decimal_amounts_and_huge_ones(spark):
    df = _txns(spark, _paid("w", "2024-04-02", 1.125) + _paid("w", "2024-04-02", 2.5))
    dec = df.withColumn("amount", F.col("amount").cast("decimal(10,3)"))
    assert rfm_base(dec).collect()[0]["monetary"] == 3.625
    assert _money(spark, [1e36, 1e40])[0] == 1e36 + 1e40


# ------------------------------------------------------------ NTILEs over several keys

@pytest.mark.parametrize("bracket_rows", [1, 20, 4096])
@pytest.mark.parametrize("size", [0, 1, 3, 4, 6, 257])
def test_ntile_columns_equal_window_ntiles(spark, size, bracket_rows):
    rnd = random.Random(size)
    rows = [(None if i == 2 else f"id{i}", rnd.choice([None, 0, 1, 1, 2]),
             rnd.choice([None, float("nan"), -1.5, 0.0, 7.25])) for i in range(size)]
    df = spark.createDataFrame(rows, "id string, a long, b double")
    tie = F.col("id").asc_nulls_last()
    expected = df.withColumns({
        "ta": F.ntile(4).over(Window.orderBy(F.col("a").desc_nulls_last(), tie)).cast("long"),
        "tb": F.ntile(4).over(Window.orderBy(F.col("b").asc_nulls_last(), tie)).cast("long")})
    got = ntile_columns(df, "id", {"ta": -F.col("a"), "tb": F.col("b")}, 4,
                        bracket_rows=bracket_rows)
    key = lambda r: str(r["id"])
    assert [(r["id"], r["ta"], r["tb"]) for r in sorted(got.collect(), key=key)] == \
        [(r["id"], r["ta"], r["tb"]) for r in sorted(expected.collect(), key=key)]


@pytest.mark.parametrize("kind", ["string", "bigint", "decimal(20,0)"])
def test_rows_at_ranks_among_heavy_ties(spark, kind):
    """Keys of very few values, so that ranks are found by parts of the id."""
    df = (spark.range(0, 30_000, 1, 7)
          .select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("few"),
                  F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.sqrt("id")).alias("many"),
                  (F.concat(F.lit("customer_number_"), F.hex("id")) if kind == "string"
                   else (F.pmod(F.col("id") * 7919, F.lit(30_011)) - 9)).cast(kind).alias("id")))
    rows = [tuple(r) for r in df.collect()]

    def order(i):
        return sorted(((r[i] is None, r[i] is not None and math.isnan(r[i]), r[i] if r[i] is not None
                        and not math.isnan(r[i]) else 0), r[2]) for r in rows)

    ranks = [0, 7_500, 14_999, 20_001, 24_500, 29_999]
    got = rows_at_ranks(df, "id", [F.col("few"), F.col("many")], lambda n: ranks, bracket_rows=300,
                        sketch_size=64)
    assert [(i, row_id) for i, _, row_id in got] == [(i, order(i)[r][1]) for i in (0, 1) for r in ranks]


def test_scores_move_no_customer(spark):
    """No exchange by range, and above the checkpoint none at all."""
    df = _txns(spark, [row for i in range(50) for row in _paid(f"c{i}", "2024-04-02", float(i % 3))])
    assert "Exchange" not in plan_text(rfm_scores(rfm_base(df)))


# ------------------------------------------------------------ global NTILE

@pytest.mark.parametrize("n", [1, 3, 4, 10])
def test_global_ntile_equals_window_ntile(spark, n):
    rnd = random.Random(n)
    rows = [(i, rnd.choice([None, 1, 2, 2, 3, 3, 3, 4]), rnd.choice([None, "a", "b"]))
            for i in range(rnd.randint(150, 260))]
    df = spark.createDataFrame(rows, "id long, v long, g string")
    order = [F.col("v").desc_nulls_last(), F.col("g").asc_nulls_last(), F.col("id").asc_nulls_last()]
    expected = {r["id"]: r["t"] for r in
                df.withColumn("t", F.ntile(n).over(Window.orderBy(*order))).collect()}
    got = {r["id"]: r["t"] for r in
           global_ntile(df, order, n, "t", partitions=6).collect()}
    assert got == expected


def test_global_ntile_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "id long")
    got = sorted((r["id"], r["t"]) for r in
                 global_ntile(df, [F.col("id")], 4, "t", partitions=2).collect())
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_ntile_formula_matches_definition(spark):
    cases = [(total, n) for total in (1, 2, 3, 4, 5, 7, 9, 13, 29) for n in (1, 2, 3, 4, 5, 10)]
    ranks = spark.range(1, 30).withColumnRenamed("id", "r")
    cols = [ntile_of_rank(F.col("r"), total, n).alias(f"c{total}_{n}") for total, n in cases]
    got = ranks.select("r", *cols).orderBy("r").collect()
    for total, n in cases:
        q, m = divmod(total, n)
        sizes = [q + 1] * m + [q] * (n - m)
        expect = [t + 1 for t, size in enumerate(sizes) for _ in range(size)]
        assert [row[f"c{total}_{n}"] for row in got[:total]] == expect, (total, n)


def test_distributed_ntile_plan_has_no_single_partition_sort(spark):
    df = spark.range(0, 1000).withColumn("v", F.col("id") % 7)
    out = global_ntile(df, [F.col("v"), F.col("id")], 4, "t", partitions=4)
    text = plan_text(out)
    assert "SinglePartition" not in text
    assert sorted(r["t"] for r in out.collect()).count(1) == 250
