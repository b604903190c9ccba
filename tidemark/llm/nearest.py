"""Approximate nearest neighbours by collision counting.

A block's rows are projected on ``projections`` random lines and sorted along
each. A query opens a window about its own projection on every line, of half
width ``WIDTH / 2`` times a radius, and the radius grows step by step over the
same sorted arrays (virtual rehashing). A row within the radius lies in a
line's window with a known probability, so a row found in at least
``threshold`` windows is a candidate and its distance is computed. The search
ends when the k-th smallest distance is within the radius: every row nearer
than that has been a candidate with the probability that set the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import BLOCK_ROWS, QUERY_ROWS, search_blocks, usable

PROJECTIONS = 64
WIDTH = 2.719
GROWTH = 1.2
MISS = 0.01
# Distances computed at once, by their number of components.
CHUNK = 1 << 21


def collision_threshold(projections: int, width: float = WIDTH, miss: float = MISS) -> int:
    """Largest count that a row at exactly the radius reaches but with
    probability ``miss``: windows hold it independently."""
    p = math.erf(width / 2 / math.sqrt(2))
    total = 0.0
    for count in range(projections + 1):
        total += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if total > miss:
            return max(1, count)
    return projections


class SortedLines:
    """Projections of the rows on random lines, sorted along each, end to end."""

    def __init__(self, data: np.ndarray, projections: int, seed: int):
        self.data, self.n = data, len(data)
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((data.shape[1], projections))
        values = data @ self.lines
        # Lines follow each other, far enough apart to be one sorted array.
        self.step = 4 * (np.abs(values).max(initial=0) + 1)
        order = np.argsort(values, axis=0, kind="stable")
        self.rows = order.T.ravel()
        self.offset = self.step * np.arange(projections)
        self.values = (np.take_along_axis(values, order, 0).T + self.offset[:, None]).ravel()
        self.first = self.n * np.arange(projections)

    def window(self, point: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        half = min(half, self.step)
        low = np.searchsorted(self.values, point - half, "left")
        high = np.searchsorted(self.values, point + half, "right")
        return np.clip(low, self.first, self.first + self.n), np.clip(high, self.first, self.first + self.n)

    def nearest(self, query: np.ndarray, skip: int, k: int, threshold: int,
                width: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and distances found, nearest first; row ``skip`` is left out."""
        wanted = min(k, self.n - (skip >= 0))
        at = query @ self.lines
        # The projection of a point beyond all rows is as good as the end's.
        point = np.clip(at, -self.step / 2 + 1, self.step / 2 - 1) + self.offset
        count = np.zeros(self.n, dtype=np.int32)
        seen = np.zeros(self.n, dtype=bool)
        if skip >= 0:
            seen[skip] = True
        rows, gaps = np.zeros(0, dtype=np.int64), np.zeros(0)
        low = high = np.searchsorted(self.values, point)
        low, high = (np.clip(x, self.first, self.first + self.n) for x in (low, high))
        # Start where a line's window holds about k rows.
        around = np.clip(low + k, self.first, self.first + self.n - 1)
        radius = max(float(np.median(np.abs(self.values[around] - point))) * 2 / width, 1e-12)
        while wanted > 0:
            new_low, new_high = self.window(point, radius * width / 2)
            met = [self.rows[a:b] for a, b in zip(new_low.tolist(), low.tolist()) if a < b]
            met += [self.rows[a:b] for a, b in zip(high.tolist(), new_high.tolist()) if a < b]
            if met:
                count += np.bincount(np.concatenate(met), minlength=self.n).astype(np.int32)
            low, high = np.minimum(low, new_low), np.maximum(high, new_high)
            found = np.flatnonzero((count >= threshold) & ~seen)
            if len(found):
                seen[found] = True
                rows = np.concatenate([rows, found])
                gaps = np.concatenate([gaps, self._gaps(query, found)])
            whole = bool((high - low >= self.n).all())
            if len(rows) >= wanted:
                worst = float(np.partition(gaps, wanted - 1)[wanted - 1])
                if worst <= radius or whole:
                    break
                # Jump ahead, but not past the radius that would end the search.
                radius = min(max(radius * growth, 1e-12), max(worst, radius * 1.0000001))
            else:
                radius *= growth
        order = np.lexsort((rows, gaps))[:k]
        return rows[order], gaps[order]

    def _gaps(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        step = max(1, CHUNK // max(1, self.data.shape[1]))
        return np.concatenate([np.sqrt(((self.data[rows[i:i + step]] - query) ** 2).sum(1))
                               for i in range(0, len(rows), step)])


def nearest_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *,
                    k: int = 10, every: int = 100, projections: int = PROJECTIONS,
                    width: float = WIDTH, growth: float = GROWTH, miss: float = MISS, seed: int = 5,
                    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): for each row whose
    vec_id is divisible by ``every``, the ``k`` nearest other rows found, ties
    to the smaller vec_id (all rows, if fewer).

    Rows whose vector is null, all zeros, or holds a null or non-finite
    component take no part. Vectors of unequal length are compared as if filled
    with zeros. Repeated ids are rows of their own; rows with a null id are
    candidates only. Other columns are ignored; an empty input gives no rows.
    """
    rows = usable(df, vec_id, vector, zero=False)
    threshold = collision_threshold(projections, width, miss)

    def best(queries, own, data, ids, places) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lines = SortedLines(data, projections, seed)
        row = {p: i for i, p in enumerate(places.tolist())}
        for query, place in zip(queries, own.tolist()):
            yield lines.nearest(query, row.get(place, -1), k, threshold, width, growth)

    return search_blocks(rows, F.col("vec_id") % every == 0, best, k, score_type="double", largest=False,
                         block_rows=block_rows, query_rows=query_rows)
