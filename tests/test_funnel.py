"""Ordered and unordered funnels: the reference's cases, the edge rules, and
the threshold plan against a literal stage-join evaluation on random data."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import EVENT_SCHEMA, at, event, event_log
from tidemark.operators import (
    DEFAULT_STAGES,
    densify_stages,
    funnel_all,
    funnel_by_segment,
    funnel_rates,
    funnel_reach,
    funnel_segment,
    funnel_unordered,
)
from tidemark.operators import funnel as funnel_module
from tidemark.plans.inspect import plan_text

STAGES = list(DEFAULT_STAGES)


def _events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def _reached(df, device):
    """Users per stage of one device."""
    return [r["unique_users"] for r in funnel_segment(funnel_by_segment(df), device)
            .orderBy("stage_order").collect()]


@pytest.fixture(scope="module")
def visits(spark):
    """Six sessions: skipped stages, a stage before its turn, one user in two
    devices, repeated events."""
    return event_log(spark, """
        v1 ana app page_view      09:00
        v1 ana app product_view   09:02
        v1 ana app add_to_cart    09:04
        v1 ana app product_view   09:05
        v1 ana app checkout_start 09:10
        v2 ana web page_view      20:00
        v2 ana web add_to_cart    20:05
        v3 bo  web product_view   08:59
        v3 bo  web page_view      09:00
        v3 bo  web product_view   09:30
        v3 bo  web purchase       10:00
        v4 cy  app page_view      11:00
        v4 cy  app page_view      11:01
        v4 cy  app product_view   11:02
        v4 cy  app add_to_cart    11:03
        v4 cy  app checkout_start 11:04
        v4 cy  app purchase       11:05
        v4 cy  app purchase       11:06
        v5 di  app page_view      12:00
        v6 bo  app page_view      13:00
        v6 bo  app product_view   13:01""")


@pytest.fixture(scope="module")
def funnel(visits):
    return funnel_by_segment(visits).cache()


def test_every_figure_of_the_visits(funnel):
    assert funnel.columns == ["device", "stage_order", "funnel_stage", "unique_users",
                              "overall_conversion_pct", "step_conversion_pct", "dropoff_pct"]
    assert [tuple(r) for r in funnel.collect()] == [
        ("app", 1, "page_view", 4, 100.0, 100.0, 0.0),
        ("app", 2, "product_view", 3, 75.0, 75.0, 25.0),
        ("app", 3, "add_to_cart", 2, 50.0, 66.67, 33.33),
        ("app", 4, "checkout_start", 2, 50.0, 100.0, 0.0),
        ("app", 5, "purchase", 1, 25.0, 50.0, 50.0),
        ("web", 1, "page_view", 2, 100.0, 100.0, 0.0),
        ("web", 2, "product_view", 1, 50.0, 50.0, 50.0),
        ("web", 3, "add_to_cart", 0, 0.0, 0.0, 100.0),
        # a stage nobody reached: no rate for the next one (E8, E11)
        ("web", 4, "checkout_start", 0, 0.0, None, None),
        ("web", 5, "purchase", 0, 0.0, None, None)]


def test_all_devices_summed(funnel):                          # E9: drop-off from the rounded step
    rows = {r["stage_order"]: tuple(r)[2:] for r in funnel_all(funnel).collect()}
    assert rows == {1: (6, 100.0, 6, 100.0, 0.0), 2: (4, 66.67, 6, 66.67, 33.33),
                    3: (2, 33.33, 4, 50.0, 50.0), 4: (2, 33.33, 2, 100.0, 0.0),
                    5: (1, 16.67, 2, 50.0, 50.0)}


def test_one_device(funnel):
    web = funnel_segment(funnel, "web").collect()
    assert {r["device"] for r in web} == {"web"} and len(web) == len(STAGES)


def test_separate_operators_equal_the_report(visits, funnel):
    dense = densify_stages(funnel_reach(visits), visits.select("device"))
    separate = sorted(funnel_rates(dense).collect(), key=lambda r: (r[0], r[1]))
    assert [tuple(r) for r in separate] == [tuple(r) for r in funnel.collect()]


# Rules one at a time: the log, and users per stage and device.
RULES = {
    "a stage before its turn does not count": (
        "s u web product_view 07:00\n s u web page_view 07:30", {"web": [1, 0, 0, 0, 0]}),
    "equal times qualify (E1)": (
        """s u web add_to_cart 07:00
           s u web page_view 07:00
           s u web product_view 07:00""", {"web": [1, 1, 1, 0, 0]}),
    "the later event's user and device count (E2, E10)": (
        "s u web page_view 07:00\n s w app product_view 07:10",
        {"web": [1, 0, 0, 0, 0], "app": [0, 1, 0, 0, 0]}),
    "no session: first stage only (E3)": (
        "- u web page_view 07:00\n - u web product_view 07:10", {"web": [1, 0, 0, 0, 0]}),
    "no time: first stage only (E4)": (
        "s u web page_view -\n s u web product_view 07:10", {"web": [1, 0, 0, 0, 0]}),
    "no user: never counted (E5)": (
        "s - web page_view 07:00\n s u web product_view 07:10", {"web": [0, 1, 0, 0, 0]}),
    "devices of other events are listed (E7)": (
        "s u web page_view 07:00\n t w kiosk search 07:10",
        {"web": [1, 0, 0, 0, 0], "kiosk": [0] * 5}),
}


@pytest.mark.parametrize("rule", RULES)
def test_rule(spark, rule):
    log, expected = RULES[rule]
    df = event_log(spark, log)
    assert {d: _reached(df, d) for d in expected} == expected


def test_null_device_has_rows_without_figures(spark):        # E6, E8
    out = funnel_by_segment(event_log(spark, "s u - page_view 07:00\n t w web page_view 07:00"))
    null_rows = [tuple(r)[3:] for r in out.collect() if r["device"] is None]
    assert null_rows == [(0, None, None, None)] * len(STAGES)


def test_unordered_funnel(spark):                            # E11, E12
    data = spark.createDataFrame(
        [(u, s) for s, users in {"land": range(8), "read": range(3, 8), "join": [4, 4, 6]}.items()
         for u in users] + [(None, "join"), (1, "other")], "user_id long, stage string")
    out = funnel_unordered(data, "stage", "user_id", ["land", "read", "join", "pay", "renew"])
    assert [tuple(r) for r in out.collect()] == [
        ("land", 8, 100.0, 100.0, 0.0), ("read", 5, 62.5, 62.5, 37.5), ("join", 2, 25.0, 40.0, 60.0),
        ("pay", 0, 0.0, 0.0, 100.0), ("renew", 0, 0.0, None, None)]
    # a first stage of 0 divides by 1; a previous stage of 0 gives NULL
    late = funnel_unordered(data, "stage", "user_id", ["pay", "join"]).collect()
    assert [tuple(r)[1:4] for r in late] == [(0, 0.0, None), (2, 200.0, None)]
    with pytest.raises(ValueError):
        funnel_unordered(data, "stage", "user_id", [])


def test_unordered_funnel_counts_each_entry_of_a_repeated_stage(spark):
    data = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "user_id long, stage string")
    out = funnel_unordered(data, "stage", "user_id", ["a", "b", "a"])
    assert [tuple(r)[:4] for r in out.collect()] == [
        ("a", 2, 100.0, 100.0), ("b", 1, 50.0, 50.0), ("a", 2, 100.0, 200.0)]


# ------------------------------------------------------------ brute force

def _literal_reach(events, stages):
    """The stage-join chain, evaluated row by row: per stage, groups
    (session, user, device) -> first time; stage k>1 joins on session with
    time >= an earlier group's first time."""
    groups = {}
    for e in events:
        if e[4] == stages[0]:
            key = (e[2], e[1], e[5])
            t = e[3]
            cur = groups.get(key, "missing")
            groups[key] = t if cur == "missing" else (cur if t is None else t if cur is None else min(cur, t))
    per_stage = [groups]
    for stage in stages[1:]:
        prev = per_stage[-1]
        nxt = {}
        for e in events:
            if e[4] != stage or e[2] is None or e[3] is None:
                continue
            if any(s == e[2] and t is not None and e[3] >= t for (s, _, _), t in prev.items()):
                key = (e[2], e[1], e[5])
                nxt[key] = e[3] if key not in nxt else min(nxt[key], e[3])
        per_stage.append(nxt)
    out = {}
    for k, groups in enumerate(per_stage, start=1):
        for (_, user, device) in groups:
            out.setdefault((device, k), set())
            if user is not None:
                out[(device, k)].add(user)
    return {key: len(v) for key, v in out.items()}


def _random_events(seed, worlds=40):
    rnd = random.Random(seed)
    out = []
    for w in range(worlds):
        for i in range(rnd.randint(5, 40)):
            sess = rnd.choice([None, f"{w}s1", f"{w}s2", f"{w}s3"])
            user = rnd.choice([None, f"{w}u1", f"{w}u2", f"{w}u3", f"{w}u4"])
            dev = rnd.choice([None, f"{w}d1", f"{w}d2"])
            hour = rnd.choice([None, 0, 1, 1, 2, 3, 3, 4, 5])
            when = None if hour is None else at(f"{hour:02}:00")
            etype = rnd.choice(STAGES[:4] + ["search"])
            out.append((f"{w}e{i}", user, sess, when, etype, dev, "x"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_plan_equals_literal_join_chain(spark, seed):
    rows = _random_events(seed)
    stages = STAGES[:4]
    got = {(r["device"], r["stage_order"]): r["unique_users"]
           for r in funnel_reach(_events(spark, rows), stages).collect()}
    assert got == _literal_reach(rows, stages)


def test_plan_filters_stage_events_and_windows_by_session(spark, visits, tmp_path):
    path = str(tmp_path / "events")
    visits.write.parquet(path)
    text = plan_text(funnel_by_segment(spark.read.parquet(path)))
    assert "In(event_type, [" in text                        # one pushed filter for all stages
    assert "IsNull(session_id)" in text and "EqualTo(event_type,page_view)" in text  # NULL sessions
    assert "windowspecdefinition(_s#" in text                # partitioned by session
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" not in text
    assert "page_category" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_hot_sessions_are_found_in_a_sample(spark):
    """All sessions at the limit are listed, none of a quarter of it, and the
    look shuffles sample rows only."""
    rows = (spark.range(0, 400_000, 1, 8)
            .select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("hot"), F.col("id") % 20))
                    .otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("_s")))
    # Ten sessions of 20,000 rows, fifty of 4,000.
    assert sorted(r[0] for r in funnel_module._hot_sessions(rows, 20_000).collect()) == \
        sorted(f"hot{2 * i}" for i in range(10))
    assert funnel_module._hot_sessions(rows, 100_000) is None
    exact = funnel_module._hot_sessions(rows, 3_999)
    assert exact.count() == 60


def test_hot_sessions_beyond_the_list_stay_in_windows(spark, monkeypatch):
    monkeypatch.setattr(funnel_module, "HOT_SESSIONS", 2)
    rows = _random_events(8, worlds=6)
    got = {(r["device"], r["stage_order"]): r["unique_users"] for r in
           funnel_reach(_events(spark, rows), STAGES[:4], hot_session_rows=1).collect()}
    assert got == _literal_reach(rows, STAGES[:4])


def test_hot_sessions_take_the_join_path(spark):
    rnd = random.Random(11)
    stages = STAGES[:4]
    rows = []
    for i in range(3000):        # two of three events sit in one session
        sess = "HOT" if i % 3 else rnd.choice([None, f"s{i % 41}"])
        rows.append((f"e{i}", rnd.choice([None, f"u{rnd.randint(0, 200)}"]), sess,
                     rnd.choice([None, at(f"{rnd.randint(0, 23):02}:00")]), rnd.choice(stages + ["x"]),
                     rnd.choice(["d1", "d2", None]), "x"))
    df = _events(spark, rows).repartition(8)
    split = funnel_reach(df, stages, hot_session_rows=100)
    got = {(r["device"], r["stage_order"]): r["unique_users"] for r in split.collect()}
    assert got == _literal_reach(rows, stages)
    plan = plan_text(split)
    assert "LeftAnti" in plan and "Window" in plan       # the window path leaves the hot session out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan   # hot rows are not moved
    # every session of three or more events on the join path, and none
    for floor in (2, None):
        again = funnel_reach(df, stages, hot_session_rows=floor)
        assert {(r["device"], r["stage_order"]): r["unique_users"] for r in again.collect()} == got
    report = funnel_by_segment(df, stages, hot_session_rows=100).collect()
    assert report == funnel_by_segment(df, stages, hot_session_rows=None).collect()


def test_session_bucketed_table_needs_no_session_shuffle(spark, tmp_path):
    import re
    rows = _random_events(5, worlds=20)
    src = _events(spark, rows)
    (src.write.bucketBy(4, "session_id").sortBy("session_id")
     .option("path", str(tmp_path / "bucketed")).saveAsTable("tidemark_events_by_session"))
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = funnel_reach(spark.table("tidemark_events_by_session"), STAGES[:4])
        got = {(r["device"], r["stage_order"]): r["unique_users"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS tidemark_events_by_session")
    assert got == _literal_reach(rows, STAGES[:4])
    assert "Window" in plan
    assert all(not k.startswith("_s") for k in re.findall(r"Exchange hashpartitioning\(([^,)]*)", plan))


def test_one_stage_and_quotes_in_stage_names(spark):
    names = ["it's", 'say "hi"']
    df = _events(spark, [event("q1", "u", "s", at("07:00"), names[0]),
                         event("q2", "w", None, at("07:10"), names[0]),
                         event("q3", "z", "t", at("07:20"), "other")])
    assert [tuple(r)[2:5] for r in funnel_by_segment(df, names[:1]).collect()] == [(names[0], 2, 100.0)]
    assert [tuple(r)[2:4] for r in funnel_by_segment(df, names).collect()] == [(names[0], 2), (names[1], 0)]
