"""Helpers shared by the operators: checkpoints, row places and permutations."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.functions.columns import require_columns
from tidemark.session import ensure_checkpoint_dir

# A row's place: input partition in the high bits, position in it in the low 33
# (the layout of ``monotonically_increasing_id``).
PLACE_BITS = 33


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frozen(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared
    folder: later stages see fixed rows, also after executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and
    read again; for wide rows, where columns are pruned by later reads."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes at its end the tables that ``stored`` has written within, but for
    those that the caller has taken from the list. No frame that reads them may
    be used after that."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.pop()
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of ``stored``, in whatever store the checkpoints are."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def quoted(df: DataFrame, *names: str) -> list[Column]:
    """Columns by exact name, whatever characters the names hold."""
    require_columns(df, *names)
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def place_partition(place: Column) -> Column:
    return F.shiftright(place, PLACE_BITS)


def place_index(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


# Runs of equal groups (one for each group and range partition that meet) are
# broadcast up to this many rows, some 10 MB.
BROADCAST_RUNS = 100_000


def ranked(df: DataFrame, group: str, order: Sequence[str],
           partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 0, in ``order``, NULLs first) and ``total``
    (rows) within its ``group``; NULL is a group. The order should be total.

    No group meets in one task: the rows are range partitioned on group and
    order together and tagged with their places; what is summed up is one count
    for each run (a group's rows in one partition). The runs are broadcast where
    a count shows at most ``BROADCAST_RUNS`` of them, else joined plainly.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = frozen(df.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
                    .withColumn("_tag", F.monotonically_increasing_id()))
    run = place_partition(F.col("_tag"))
    in_group = Window.partitionBy("_group")
    before = in_group.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (tagged.groupBy(F.col(group).alias("_group"), run.alias("_run"))
            .agg(F.min("_tag").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .select("_group", "_run", F.sum("_n").over(in_group).alias("total"),
                    (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    runs = frozen(runs)
    few = runs.count() <= BROADCAST_RUNS
    return (tagged.join(F.broadcast(runs) if few else runs,
                        F.col(group).eqNullSafe(F.col("_group")) & (run == F.col("_run")))
            .withColumn("rank", F.col("_tag") + F.col("_shift"))
            .drop("_tag", "_group", "_run", "_first", "_shift"))


# Rows of one range partition where running sums are taken.
RUN_ROWS = 10_000


def running_sums(df: DataFrame, order: Sequence[Column | str],
                 sums: Mapping[str, Column]) -> DataFrame:
    """``df`` (fixed, see ``frozen``) with, for each name of ``sums``, the sum of
    its column over the rows ahead in ``order``, and the sum over all rows as
    ``<name>_all``. The order must be total.

    The rows are range partitioned on the order and summed within partitions of
    about ``RUN_ROWS`` rows; one row of sums a partition gives the offsets.
    """
    shuffles = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(shuffles, df.count() // RUN_ROWS))
    given = [column.alias(f"_{name}") for name, column in sums.items()]
    tagged = frozen(df.select("*", *given).repartitionByRange(parts, *order)
                    .sortWithinPartitions(*order)
                    .withColumn("_tag", F.monotonically_increasing_id())
                    .withColumn("_run", place_partition(F.col("_tag"))))
    ahead = Window.partitionBy("_run").orderBy("_tag").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = tagged.groupBy("_run").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])

    def over(name: str, window: WindowSpec) -> Column:
        total = F.sum(f"_{name}").over(window)
        return F.coalesce(total, F.lit(0).cast(tagged.schema[f"_{name}"].dataType))

    runs = runs.select("_run", *[over(n, earlier).alias(f"_{n}_run") for n in sums],
                       *[over(n, Window.partitionBy()).alias(f"{n}_all") for n in sums])
    return (tagged.select("*", *[over(n, ahead).alias(f"_{n}_ahead") for n in sums])
            .join(F.broadcast(runs), "_run")
            .select(*df.columns, *[(F.col(f"_{n}_run") + F.col(f"_{n}_ahead")).alias(n) for n in sums],
                    *[f"{n}_all" for n in sums]))


def permuted(index: Column, n: Column, seed: Column, rounds: int = 24) -> Column:
    """Place of ``index`` in a pseudorandom permutation of ``0 .. n-1``.

    A swap-or-not shuffle: in each round an index and its mirror about a
    keyed point trade places or not, by one hashed bit of the larger of the
    two. Each round is its own inverse, so the whole is one-to-one on any
    ``n`` >= 1 without tables; ``seed`` selects the permutation. Built-in
    functions only.
    """
    def one_round(s: Column, x: Column, r: Column) -> Column:
        point = F.xxhash64(s["seed"], r, F.lit(0)).bitwiseAND(F.lit((1 << 62) - 1))
        mirror = F.pmod(point - x, s["n"])
        coin = F.xxhash64(s["seed"], r, F.greatest(x, mirror)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, mirror).otherwise(x)

    # One element, so that the rounds see values, not the expressions behind them.
    given = F.array(F.struct(index.cast("long").alias("i"), n.cast("long").alias("n"),
                             seed.cast("long").alias("seed")))
    return F.get(F.transform(given, lambda s: F.reduce(
        F.sequence(F.lit(1), F.lit(rounds)), s["i"], lambda x, r: one_round(s, x, r))), F.lit(0))
