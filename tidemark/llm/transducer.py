"""A minimal acyclic transducer: sorted words in, each word's place out.

Built from sorted words in one sweep: a state is frozen as soon as no later word
can pass it, and a frozen state equal to an earlier one (same finality, same
edges) is replaced by that one, so the automaton is minimal at every step.
Every edge carries the number of words that come before it among those through
its state; the numbers along a word's path add up to its ordinal.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Sequence

import numpy as np


class Transducer:
    """``ordinals`` of many words at once; the words are byte strings."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, weights: np.ndarray,
                 final: np.ndarray, start: int):
        # Edges sorted by ``state << 8 | byte``.
        self.keys, self.targets, self.weights = keys, targets, weights
        self.final, self.start = final, start

    @classmethod
    def build(cls, words: Iterable[bytes]) -> Transducer:
        """From distinct words in byte order."""
        known: dict[tuple, int] = {}
        below: list[int] = []       # words from a state on
        edges: list[tuple] = []
        ends: list[bool] = []
        # The states along the latest word: [is final, edges so far].
        path: list[list] = [[False, []]]

        def frozen(state: list) -> int:
            key = (state[0], tuple(state[1]))
            number = known.get(key)
            if number is None:
                number = known[key] = len(below)
                below.append(state[0] + sum(below[t] for _, t in state[1]))
                edges.append(key[1])
                ends.append(state[0])
            return number

        def shorten(to: int, word: bytes) -> None:
            for depth in range(len(path) - 1, to, -1):
                number = frozen(path.pop())
                path[-1][1].append((word[depth - 1], number))

        last: bytes | None = None
        for word in words:
            if last is not None and word <= last:
                raise ValueError("a transducer needs distinct words in byte order")
            same = 0
            if last is not None:
                limit = min(len(word), len(last))
                while same < limit and word[same] == last[same]:
                    same += 1
                shorten(same, last)
            path.extend([False, []] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        if last is not None:
            shorten(0, last)
        start = frozen(path[0])
        keys, targets, weights = [], [], []
        for state, out in enumerate(edges):
            before = int(ends[state])
            for byte, target in out:
                keys.append(state << 8 | byte)
                targets.append(target)
                weights.append(before)
                before += below[target]
        return cls(np.array(keys, dtype=np.int64), np.array(targets, dtype=np.int64),
                   np.array(weights, dtype=np.int64), np.array(ends, dtype=bool), start)

    @property
    def states(self) -> int:
        return len(self.final)

    def ordinals(self, words: Sequence[bytes]) -> np.ndarray:
        """Each word's place among the words of the transducer, -1 if it has none.
        All words move together, one byte at a time."""
        n = len(words)
        found = np.full(n, -1, dtype=np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.cumsum(size) - size
        row, state = np.arange(n), np.full(n, self.start, dtype=np.int64)
        number = np.zeros(n, dtype=np.int64)
        step = 0
        while len(row):
            ended = size[row] == step
            done = row[ended]
            found[done] = np.where(self.final[state[ended]], number[ended], -1)
            row, state, number = row[~ended], state[~ended], number[~ended]
            if not len(row) or not len(self.keys):
                break
            key = state << 8 | data[at[row] + step]
            edge = np.searchsorted(self.keys, key)
            edge[edge == len(self.keys)] = 0
            on = self.keys[edge] == key
            row, edge = row[on], edge[on]
            state, number = self.targets[edge], number[on] + self.weights[edge]
            step += 1
        return found

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, keys=self.keys, targets=self.targets, weights=self.weights,
                 final=self.final, start=np.int64(self.start))
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as a:
            return cls(a["keys"], a["targets"], a["weights"], a["final"], int(a["start"]))
