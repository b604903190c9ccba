"""Uniform shuffle into shards of exact sizes, in DataFrame functions only.

How many rows of each input partition go to each shard is drawn first: a
matrix with the partitions' row counts as row sums and the shards' sizes as
column sums, distributed as under a uniform permutation of all rows
(hypergeometric draws, a few numbers per partition, on the driver). Every
partition's rows are permuted locally and dealt out by their row of the matrix;
after the exchange each shard's rows are permuted again. Local orders are
computed by a keyed permutation of the row's place, so no task sorts or holds
a partition, a shard or a group of equal rows.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, permuted, place_index, place_partition, quoted

SHARDS = 8
# Rows of one shard that an exchange gives to one task.
EXCHANGE_ROWS = 1 << 20
# A larger matrix is joined by a shuffle instead of being broadcast.
BROADCAST_PARTITIONS = 50_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` taken without replacement.

    Inversion outward from the mode: the steps taken are of the order of the
    standard deviation, also where rounding leaves a rest of ``u`` after the
    last value with any probability.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode)
                 - log_choose(good + bad, draws))
    u, below, above, p_below, p_above = rng.random() - p, mode, mode, p, p
    while u > 0 and ((below > low and p_below) or (above < high and p_above)):
        if above < high:
            p_above *= (good - above) * (draws - above) / ((above + 1) * (bad - draws + above + 1))
            above += 1
            u -= p_above
            if u <= 0:
                return above
        if below > low:
            p_below *= below * (bad - draws + below) / ((good - below + 1) * (draws - below + 1))
            below -= 1
            u -= p_below
            if u <= 0:
                return below
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each partition (of ``counts``) for each shard; shard sizes
    differ by at most one."""
    total, rng = sum(counts), random.Random(seed)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for n in counts:
        row, left, rest = [], n, sum(room)
        for j in range(shards):
            rest -= room[j]
            x = hypergeometric(rng, room[j], rest, left)
            row.append(x)
            left -= x
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffled_shards(df: DataFrame, shards: int = SHARDS, seed: int = 31) -> DataFrame:
    """The input's rows with ``shard`` (0 up) and ``slot`` (place in the shard,
    gapless from 0), in a struct column ``row`` beside them.

    Every row has its own place, so repeated rows, nulls and clashing column
    names make no difference. An empty input gives no rows. The input is fixed
    by a checkpoint first: select the columns that are needed.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    base = frozen(df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")))
    part = place_partition(F.col("place"))
    counts = sorted(base.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    matrix = communication_matrix([r["n"] for r in counts], shards, seed)
    before, plan = [0] * shards, []
    for r, row in zip(counts, matrix):
        tops = [0, *accumulate(row)]
        # A dealt row's place in its shard is its local place plus this.
        plan.append((r["part"], r["n"], tops, [b - t for b, t in zip(before, tops)]))
        before = [a + b for a, b in zip(before, row)]
    dealt = spark.createDataFrame(plan, "part long, n long, tops array<long>, shift array<long>")
    if len(plan) <= BROADCAST_PARTITIONS:
        dealt = F.broadcast(dealt)
    rows = (base.withColumn("part", part).join(dealt, "part")
            .withColumn("local", permuted(place_index(F.col("place")), F.col("n"),
                                          F.xxhash64(F.lit(seed), "part")))
            # The shard whose share of the partition's order holds the row.
            .withColumn("shard", F.size(F.filter(
                F.slice("tops", 1, shards), lambda t: t <= F.col("local"))) - 1)
            .select("row", "shard", (F.col("local") + F.get("shift", F.col("shard"))).alias("came")))
    exchanged = rows.repartition("shard", F.floor(F.col("came") / EXCHANGE_ROWS))
    sizes = F.array(*[F.lit(n).cast("long") for n in before])
    return exchanged.select("row", "shard", permuted(
        F.col("came"), F.get(sizes, F.col("shard")),
        F.xxhash64(F.lit(seed), F.lit("shard"), "shard")).alias("slot"))


def shard_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                    shards: int = SHARDS, seed: int = 31) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law (``rows``: shard sizes
    differ by at most one row), shard, slot, grown_shard (null) for every row.

    A null text has size 1 and the crc32 of no bytes.
    """
    key, body = quoted(df, doc_id, text)
    rows = shuffled_shards(df.select(
        key.alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32")), shards, seed)
    return rows.select("row.*", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))
