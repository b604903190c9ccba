"""Mixing against a plain calculation of the targets, and with many sources."""

from fractions import Fraction

import pytest

from tidemark.llm import frames, mixing


def plain_targets(sizes, weights=(1, 2, 3), takes=3):
    """Targets by sharing round after round until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = Fraction(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > takes * sizes[s]}
        for s in full or open_:
            target[s] = Fraction(takes * sizes[s]) if full else share * weight[s]
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ -= full
    return target


WORLDS = [
    {"a": 1000, "b": 10, "c": 1, "é": 300, None: 40, "B": 0},
    {"a": 5},
    {"x": 0, None: 0},
    {f"s{i}": (i * i) % 97 + (5000 if i == 3 else 0) for i in range(60)},
]


@pytest.mark.parametrize("world", WORLDS)
def test_targets_equal_a_plain_calculation(spark, world):
    rows = [(s, n // 2) for s, n in world.items()] + [(s, n - n // 2) for s, n in world.items()]
    got = mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), block_words=4).collect()
    want = plain_targets(world)
    assert {r.source: r.source_size for r in got} == world
    for r in got:
        assert r.target == pytest.approx(float(want[r.source]), abs=1e-6)
        assert r.quota <= 3 * r.blocks


@pytest.mark.parametrize("broadcast", [50_000, 5])
def test_many_sources_with_a_hot_one(spark, monkeypatch, broadcast):
    """Both ways to meet the sources give each of them its quota."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    monkeypatch.setattr(mixing, "CELL", 64)
    monkeypatch.setattr(frames, "RUN_ROWS", 500)
    many = 5000
    df = spark.range(2 * many).selectExpr(
        "id as doc_id", "repeat('w ', cast(id % 7 as int)) as text",
        f"if(id % 3 = 0, 'hot', concat('s', id % {many})) as source")
    rows = mixing.mix_sources(df, block_words=8, shard_slots=256).collect()
    assert len(rows) == 2 * many
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = plain_targets({s: sum(r.size for r in v) for s, v in by.items()})
    for s, v in by.items():
        assert v[0].target == pytest.approx(float(want[s]), abs=1e-6)
        assert abs(sum(r.taken for r in v) - v[0].target) <= 16


def test_running_sums(spark):
    df = frames.frozen(spark.createDataFrame([(i * 7 % 50, i) for i in range(50)] + [(None, 9)], "k int, v long"))
    got = frames.running_sums(df, ["k"], {"ahead": df.v}).orderBy("k").collect()
    total = 0
    for r in got:
        assert (r.ahead, r.ahead_all) == (total, sum(range(50)) + 9)
        total += r.v
