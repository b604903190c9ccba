"""Blocks of vectors: a query set searched against all rows, block by block.

Rows are dealt to blocks by their place in the input, evenly whatever their
ids or values, and queries to query blocks; one task gets one block of each
(both bounded) and returns each query's best rows of the block. The best of
all blocks are then ranked per query. The queries are a stated share of the
rows, so this is a blocked search, not a join of all with all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, quoted

BLOCK_ROWS = 1 << 16
QUERY_ROWS = 1 << 13


def usable(df: DataFrame, vec_id: str, vector: str, zero: bool = True) -> DataFrame:
    """vec_id, v (array of double) and place of the rows whose vector is not
    null and holds only finite numbers (and, without ``zero``, some other than
    0), fixed by a checkpoint."""
    key, v = quoted(df, vec_id, vector)
    finite = F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    good = v.isNotNull() & finite
    if not zero:
        good = good & F.exists(v, lambda x: x != 0)
    return frozen(df.where(good).select(
        key.cast("long").alias("vec_id"), v.cast("array<double>").alias("v"),
        F.monotonically_increasing_id().alias("place")))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Rows of one width; shorter vectors are filled with zeros."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def search_blocks(rows: DataFrame, is_query: Column, best: Callable, k: int, *, score_type: str,
                  largest: bool, block_rows: int = BLOCK_ROWS,
                  query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best other rows, ties
    to the smaller vec_id.

    ``best(queries, query_places, data, ids, places)`` yields per query (row
    numbers of the data, scores): its best rows of the block without itself.
    ``rows`` comes from ``usable``.
    """
    spark = rows.sparkSession
    queries = rows.where(is_query)
    n, q = rows.count(), queries.count()
    blocks = max(1, min(n, max(-(-n // block_rows), 2 * spark.sparkContext.defaultParallelism)))
    groups = max(1, -(-q // query_rows))

    def dealt(df: DataFrame, name: str, many: int, other: str, others: int) -> DataFrame:
        turn = F.pmod(F.col("place") + F.shiftright("place", 33), F.lit(many)).cast("int")
        # Rows of a query set lie at regular places: mix them before dealing.
        turn = turn if name == "block" else F.pmod(F.xxhash64("place"), F.lit(many)).cast("int")
        return df.select("vec_id", "v", "place", turn.alias(name),
                         F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asked):
            ids, places = data["vec_id"].to_numpy(), data["place"].to_numpy()
            order = np.lexsort((places, ids))
            ids, places = ids[order], places[order]
            points, wanted = same_width(matrix(data["v"].iloc[order]), matrix(asked["v"]))
            found = best(wanted, asked["place"].to_numpy(), points, ids, places)
            for query, place, (at, scores) in zip(asked["vec_id"], asked["place"], found):
                out.append(pd.DataFrame({"query_id": query, "asked": place, "vec_id": ids[at],
                                         "met": places[at], "score": scores}))
        if not out:
            return pd.DataFrame({c: [] for c in ("query_id", "asked", "vec_id", "met", "score")})
        return pd.concat(out, ignore_index=True)

    found = (dealt(rows, "block", blocks, "group", groups).groupBy("block", "group")
             .cogroup(dealt(queries, "group", groups, "block", blocks).groupBy("block", "group"))
             .applyInPandas(search, f"query_id long, asked long, vec_id long, met long, score {score_type}"))
    order = F.col("score").desc() if largest else F.col("score").asc()
    ranks = Window.partitionBy("asked").orderBy(order, "vec_id", "met")
    return (found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
