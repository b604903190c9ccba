"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, ending with the assistant. Dynamic programming over the
automaton of the last role finds the cheapest way to make a conversation legal
by merging a turn into the one before, relabelling it, or inserting empty
turns; the repaired turns are rendered row by row.

A turn is a matrix of costs from state to state, and matrices combine
(min-plus), so a conversation may be cut anywhere: rows are range-partitioned
and sorted by conversation and turn, and where a conversation crosses tasks the
matrices of its pieces (one 4 x 4 matrix for each task's first and last
conversation) give the states at the cuts. So a conversation of any length is
repaired exactly without being gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, quoted

ROLES = ("system", "user", "assistant")
STATES = ("", *ROLES)  # the role of the last turn; none at the start
MERGE, RELABEL, INSERT = 1, 2, 3
TASK_ROWS = 100_000
# Roles that may follow a role.
FOLLOWS = {"": ("system", "user"), "system": ("user",), "user": ("assistant",),
           "assistant": ("user",)}
HEAD, TAIL, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def options(role: str | None, merge: int = MERGE, relabel: int = RELABEL,
            insert: int = INSERT) -> list[tuple[int, int, int, str, tuple[str, ...]]]:
    """What can be done with a turn of ``role``: (state before, state after,
    cost, action, empty turns put before), the plainest first among equals."""
    found = []
    for s, last in enumerate(STATES):
        for t, new in enumerate(STATES):
            if not new:
                continue
            other = 0 if new == role else relabel
            name = "keep" if new == role else "relabel"
            if new in FOLLOWS[last]:
                found.append((s, t, other, name, ()))
            else:
                middle = [m for m in FOLLOWS[last] if new in FOLLOWS[m]]
                if middle:
                    found.append((s, t, other + insert, name, (middle[-1],)))
            if last == new:
                found.append((s, t, other + merge, "merge" if new == role else "relabel and merge", ()))
    return sorted(found, key=lambda o: o[2])


def closing(state: int) -> tuple[str, ...]:
    """Empty turns that complete a conversation whose last turn is ``state``."""
    return {"": (), "system": ("user", "assistant"), "user": ("assistant",),
            "assistant": ()}[STATES[state]]


class Repair:
    """The dynamic program, with costs fixed."""

    def __init__(self, merge: int, relabel: int, insert: int):
        self.insert = insert
        self.by_role = {r: options(r, merge, relabel, insert) for r in (*ROLES, None)}
        self.matrices = {}
        for r, found in self.by_role.items():
            m = np.full((4, 4), np.inf)
            for s, t, cost, *_ in found:
                m[s, t] = min(m[s, t], cost)
            self.matrices[r] = m
        self.end = np.array([insert * len(closing(s)) for s in range(4)], dtype=float)

    def role(self, role) -> str | None:
        return role if role in ROLES else None

    def product(self, roles: list) -> np.ndarray:
        out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
        for r in roles:
            out = combined(out, self.matrices[self.role(r)])
        return out

    def path(self, roles: list, start: int, end: int | None) -> list[tuple]:
        """The cheapest option for each turn, from state ``start`` to ``end``
        (None: to whatever state is cheapest to close)."""
        costs, back = [np.inf] * 4, []
        costs[start] = 0
        for r in roles:
            new, how = [np.inf] * 4, [None] * 4
            for o in self.by_role[self.role(r)]:
                c = costs[o[0]] + o[2]
                if c < new[o[1]]:
                    new[o[1]], how[o[1]] = c, o
            costs = new
            back.append(how)
        state = int(np.argmin(np.array(costs) + self.end)) if end is None else end
        taken = []
        for how in reversed(back):
            taken.append(how[state])
            state = how[state][0]
        return taken[::-1]


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(1)


def _turn(role: str) -> str:
    return HEAD.format(role) + TAIL


def render(path: list[tuple], texts: list, start: int, last: bool) -> Iterator[tuple[str, str]]:
    """(rendered text, empty turns put after) of each row."""
    for n, ((s, t, _, action, before), text) in enumerate(zip(path, texts)):
        text = "" if text is None else text
        if action.endswith("merge"):
            out = JOINT + text
        else:
            out = (TAIL if s else "") + "".join(map(_turn, before)) + HEAD.format(STATES[t]) + text
        after = closing(t) if last and n == len(path) - 1 else ()
        if last and n == len(path) - 1:
            out += TAIL + "".join(map(_turn, after))
        yield out, ",".join(after)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The conversations of a task's sorted rows, whole within the task."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        conv, none = batch["conv_id"], batch["conv_id"].isna()
        starts = (conv.ne(conv.shift()) & ~(none & none.shift(fill_value=False))).to_numpy().copy()
        if held:
            last = held[-1]["conv_id"].iloc[-1]
            starts[0] = not (last == conv.iloc[0] or (pd.isna(last) and none.iloc[0]))
        else:
            starts[0] = False
        cuts = [0, *np.flatnonzero(starts), len(batch)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if i and held:
                yield pd.concat(held, ignore_index=True)
                held = []
            if a < b:
                held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held, ignore_index=True)


def _cut_states(pieces: list, repair: Repair) -> dict[int, dict[str, tuple[int, int | None]]]:
    """Per task: for its ``first`` and ``last`` conversation the states in
    which the task's piece of it begins and ends (None: it ends there)."""
    chains: list[list] = []
    for p in pieces:
        goes_on = (chains and p["edge"] in ("first", "only") and chains[-1][-1]["conv_id"] == p["conv_id"]
                   and chains[-1][-1]["edge"] in ("last", "only"))
        if goes_on:
            chains[-1].append(p)
        else:
            chains.append([p])
    found: dict[int, dict[str, tuple[int, int | None]]] = {}
    for chain in chains:
        cost, costs = np.array([0.0, np.inf, np.inf, np.inf]), []
        for p in chain:
            costs.append(cost)
            cost = (cost[:, None] + np.array(p["matrix"]).reshape(4, 4)).min(0)
        state, ends = int(np.argmin(cost + repair.end)), None
        for p, before in zip(reversed(chain), reversed(costs)):
            begin = int(np.argmin(before + np.array(p["matrix"]).reshape(4, 4)[:, state]))
            found.setdefault(p["part"], {})[p["edge"]] = (begin, state if ends is not None else None)
            state = ends = begin
    return found


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", *, merge: int = MERGE, relabel: int = RELABEL,
                 insert: int = INSERT, task_rows: int = TASK_ROWS) -> DataFrame:
    """conv_id, turn, role, action, out_role, put_before, put_after, cost,
    rendered for every row.

    ``action`` is keep, relabel, merge, or relabel and merge; ``put_before``
    and ``put_after`` name the empty turns inserted ('' if none); ``cost`` is
    the row's share of its conversation's cost, the least there is. A
    conversation's ``rendered`` in turn order, put end to end, is the formatted
    conversation. Turns are ordered by turn and role (nulls first), ties by a
    hash of the text; repeated rows are turns of their own; a null or unknown role must be
    relabelled; a null text is empty; rows with a null conv_id are one
    conversation. Other columns are ignored; an empty input gives no rows.
    """
    spark, repair = df.sparkSession, Repair(merge, relabel, insert)
    c, t, r, x = quoted(df, conv_id, turn, role, text)
    rows = df.select(c.alias("conv_id"), t.alias("turn"), r.alias("role"), x.alias("text"))
    # The place deals out rows that are equal in all else, whatever their number.
    keys = ["conv_id", "turn", "role", "mark", "place"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // task_rows))
    rows = frozen(rows.withColumn("mark", F.xxhash64("text"))
                  .withColumn("place", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys)
                  .sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for run in _runs(batches):
            piece = (int(run["part"].iloc[0]), run["conv_id"].iloc[0], run["role"].tolist())
            first, last = first or piece, piece
        if first is None:
            return
        kept = [("only", first)] if first is last else [("first", first), ("last", last)]
        yield pd.DataFrame([{"part": p, "conv_id": i, "edge": edge,
                             "matrix": repair.product(roles).ravel().tolist()}
                            for edge, (p, i, roles) in kept])

    kind = rows.schema["conv_id"].dataType.simpleString()
    # Two rows for each task.
    pieces = sorted((rows.select("part", "conv_id", "role").mapInPandas(
        edges, f"part int, conv_id {kind}, edge string, matrix array<double>").collect()),
        key=lambda p: (p["part"], p["edge"] == "last"))
    states = _cut_states(pieces, repair)

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: list[pd.DataFrame] = []
        held = 0

        def repaired(run: pd.DataFrame, edge: str) -> pd.DataFrame:
            start, end = states.get(int(run["part"].iloc[0]), {}).get(edge, (0, None))
            path = repair.path(run["role"].tolist(), start, end)
            out = list(render(path, run["text"].tolist(), start, end is None))
            return pd.DataFrame({
                "conv_id": run["conv_id"], "turn": run["turn"], "role": run["role"],
                "action": [o[3] for o in path], "out_role": [STATES[o[1]] for o in path],
                "put_before": [",".join(o[4]) for o in path], "put_after": [a for _, a in out],
                "cost": [o[2] + repair.insert * len(a.split(",") if a else ())
                         for o, (_, a) in zip(path, out)],
                "rendered": [text for text, _ in out]})

        # A run is known to be the last only when no other follows.
        before = None
        nth = 0
        for run in _runs(batches):
            if before is not None:
                done.append(repaired(before, "first" if nth == 1 else ""))
                held += len(before)
                if held >= 10_000:
                    yield pd.concat(done, ignore_index=True)
                    done, held = [], 0
            before, nth = run, nth + 1
        if before is not None:
            done.append(repaired(before, "only" if nth == 1 else "last"))
            yield pd.concat(done, ignore_index=True)

    turn_kind = rows.schema["turn"].dataType.simpleString()
    return rows.select("conv_id", "turn", "role", "text", "part").mapInPandas(
        formatted, f"conv_id {kind}, turn {turn_kind}, role string, action string, out_role string, "
                   "put_before string, put_after string, cost int, rendered string")
