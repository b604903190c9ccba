"""Exact top-k inner products by a dual-tree search over cover trees.

Both the queries and the rows of a block are held in a cover tree: a node is a
ball about one of its points; its children's centres, the node's own first,
are chosen farthest-first, so that they lie at least some distance apart and
every point lies within that distance of its child's centre. Pairs of a query
node and a row node are visited together. A pair is dropped when no query of
the one can have an inner product with a row of the other that reaches the
worst k-th score among the node's queries:

    <q, x> <= <cq, cx> + |cq| rx + |cx| rq + rq rx

Scores are whole numbers and always exact: sums in double precision while they
stay below 2^53, in 64-bit integers below 2^63, else in Python's integers. The
trees and bounds hold the vectors divided by their largest component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import BLOCK_ROWS, QUERY_ROWS, search_blocks, usable

FANOUT = 16
LEAF = 48
# Sums below these are exact in double precision, and in 64-bit integers.
EXACT, LONG = 1 << 53, 1 << 63


class Node:
    __slots__ = ("center", "radius", "rows", "children", "centers", "norms", "radii")

    def __init__(self, center: np.ndarray, radius: float, rows: np.ndarray):
        self.center, self.radius, self.rows, self.children = center, radius, rows, []


def cover_tree(points: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF) -> Node:
    """Tree over the row numbers of ``points``. Points that cannot be told
    apart share a leaf."""
    def distances(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[rows] - at) ** 2).sum(1))

    def grow(rows: np.ndarray, first: int) -> Node:
        gap = distances(rows, points[first])
        node = Node(points[first], float(gap.max()), rows)
        if len(rows) <= leaf or node.radius == 0:
            return node
        centers, owner = [first], np.zeros(len(rows), dtype=np.int64)
        while len(centers) < fanout and gap.max() > 0:
            centers.append(rows[int(gap.argmax())])
            new = distances(rows, points[centers[-1]])
            owner[new < gap] = len(centers) - 1
            gap = np.minimum(gap, new)
        node.children = [grow(rows[owner == i], c) for i, c in enumerate(centers)]
        node.centers = np.stack([c.center for c in node.children])
        node.norms = np.sqrt((node.centers ** 2).sum(1))
        node.radii = np.array([c.radius for c in node.children])
        return node

    return grow(np.arange(len(points)), 0)


def _parts(node: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    if node.children:
        return node.children, node.centers, node.norms, node.radii
    center = node.center[None]
    return [node], center, np.sqrt((center ** 2).sum(1)), np.array([node.radius])


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component: doubles, or Python integers where
    doubles would not hold the product."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * float(scale))
    if np.abs(out).max(initial=0) < EXACT:
        return out
    # From 2^53 on a double is a whole number itself.
    return np.array([[int(x) * scale if abs(x) >= EXACT else math.floor(x * scale) for x in row]
                     for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


def dual_tree_topk(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray,
                   places: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query, the row numbers and scores of its ``k`` largest inner
    products, ties to the earlier row; the row at the query's own place is
    left out. All vectors hold whole numbers (see ``whole``).

    A score that no long can hold raises ``ArithmeticError``.
    """
    largest = max(1, *(int(np.abs(a).max(initial=0)) for a in (queries, data)))
    reach = largest * largest * max(1, data.shape[1])
    kind, low = ((np.float64, -np.inf) if reach < EXACT else (np.int64, -LONG) if reach < LONG
                 else (object, -2 * reach))
    asked = cover_tree((queries / largest).astype(np.float64))
    held = cover_tree((data / largest).astype(np.float64))
    if kind is object:
        queries, data = (np.array([[int(x) for x in row] for row in a.tolist()], dtype=object)
                         .reshape(a.shape) for a in (queries, data))
    else:
        queries, data = queries.astype(kind), data.astype(kind)
    scores = np.full((len(queries), k), low, dtype=kind)
    rows = np.full((len(queries), k), len(data), dtype=np.int64)

    def worst(q: Node) -> float:
        """The worst k-th score of a node's queries, in the trees' measure."""
        least = scores[q.rows, -1].min()
        return -np.inf if least == low else int(least) / largest ** 2

    def falling(every: np.ndarray) -> np.ndarray:
        return ~every if kind is np.int64 else -every   # the least long has no negative

    def meet(q: Node, x: Node) -> None:
        got = queries[q.rows] @ data[x.rows].T
        got = np.where(own[q.rows][:, None] == places[x.rows][None], low, got)
        some = np.flatnonzero((got >= scores[q.rows, -1:]).any(1))
        if not len(some):
            return
        at = q.rows[some]
        every = np.concatenate([scores[at], got[some]], 1)
        number = np.concatenate([rows[at], np.broadcast_to(x.rows, (len(at), len(x.rows)))], 1)
        number = np.where(every == low, len(data), number)
        order = np.lexsort((number, falling(every)))[:, :k]
        scores[at] = np.take_along_axis(every, order, 1)
        rows[at] = np.take_along_axis(number, order, 1)

    # Depth first, the most promising pair of a query node first.
    stack = [(asked, held, np.inf)]
    while stack:
        q, x, bound = stack.pop()
        # Slack for rounding in the bound: only pairs surely below are dropped.
        if bound + 1e-6 * (1 + abs(bound)) < worst(q):
            continue
        if not q.children and not x.children:
            meet(q, x)
            continue
        qs, qc, qn, qr = _parts(q)
        xs, xc, xn, xr = _parts(x)
        bounds = (qc @ xc.T + qn[:, None] * xr[None] + qr[:, None] * xn[None]
                  + qr[:, None] * xr[None])
        for i, j in zip(*np.unravel_index(np.argsort(bounds, axis=None), bounds.shape)):
            stack.append((qs[i], xs[j], float(bounds[i, j])))
    for s, r in zip(scores, rows):
        full = r < len(data)
        if kind is object and any(not -LONG <= x < LONG for x in s[full]):
            raise ArithmeticError("an inner product exceeds the range of a long")
        yield r[full], s[full].astype(np.int64)


def exact_topk(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", *, k: int = 10,
               every: int = 100, scale: int = 1024, block_rows: int = BLOCK_ROWS,
               query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by
    ``every``, the ``k`` other rows with the largest inner products of
    ``floor(scale * x)``, ties to the smaller vec_id (all rows, if fewer).

    Rows whose vector is null or holds a null or non-finite component take no
    part. Vectors of unequal length are compared as if filled with zeros.
    Repeated ids are rows of their own: a query meets its copies, not itself.
    Rows with a null id are candidates only. Scores are exact at any size of
    the components; one that no long can hold is an error. Other columns are
    ignored; an empty input gives no rows.
    """
    rows = usable(df, vec_id, vector)

    def best(queries, own, data, ids, places):
        return dual_tree_topk(whole(queries, scale), own, whole(data, scale), ids, places, k)

    return search_blocks(rows, F.col("vec_id") % every == 0, best, k, score_type="long", largest=True,
                         block_rows=block_rows, query_rows=query_rows)
