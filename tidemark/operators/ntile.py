"""Exact global ``NTILE(n) OVER (ORDER BY ...)`` without a one-task sort.

``Window.orderBy`` with no partition moves every row into one partition. The
operators here avoid that at every size:

* ``global_ntile``  - one NTILE over any order. The rows are range-partitioned on
  the full (total) order (Spark samples the keys; a unique tie-break at the end
  of the order lets heavy ties spread), sorted within each partition and tagged
  with ``partition << 33 | position``; row counts per partition (one number
  each) turn tags into ranks. Whole rows move once, and the tagged rows are
  checkpointed, so that the tags stay fixed when executors go.
* ``rows_at_ranks`` - exact selection by quantile sketches: the rows at given
  ranks of several orders, without sorting or moving the frame.
* ``ntile_columns`` - several NTILEs over numeric keys of one frame with a
  unique id: ``rows_at_ranks`` finds the row that ends each tile, and all rows
  are compared with those cut rows in one narrow projection.

The selection narrows each rank's rows in rounds. A round is two aggregates, one
row a task: a mergeable quantile sketch (KLL) of the rows still in question gives
two of their values about the rank; then the rows below, at, between and above the
two are counted, and those where the rank must lie stay. The counts are exact, so
the sketch's error costs rounds, never correctness, and every round drops rows.
Rows tied in the key go on by the id, an integer as it is, a text six bytes at a
time; ids of other types are range partitioned from there on. What is left of a rank, at most ``bracket_rows`` rows, is sorted.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from tidemark.session import ensure_checkpoint_dir

_POSITION_BITS = 33      # of monotonically_increasing_id


def ntile_of_rank(rank: Column, total: int, n: int) -> Column:
    """Tile (1..n) of a 1-based rank among ``total`` rows, as SQL NTILE assigns it."""
    if n < 1:
        raise ValueError("NTILE needs n >= 1")
    q, m = divmod(total, n)
    big = m * (q + 1)
    first = F.floor((rank - 1) / F.lit(q + 1)) + 1
    if q == 0:
        return first.cast("long")
    rest = F.floor((rank - 1 - F.lit(big)) / F.lit(q)) + 1 + F.lit(m)
    return F.when(rank <= F.lit(big), first).otherwise(rest).cast("long")


def tile_ends(total: int, n: int) -> list[int]:
    """Last rank of each tile but the last one, empty tiles left out."""
    if n < 1:
        raise ValueError("NTILE needs n >= 1")
    q, m = divmod(total, n)
    return [t * q + min(t, m) for t in range(1, n) if t <= m or q]


def _tagged(df: DataFrame, order: Sequence[Column], partitions: int | None) -> tuple[DataFrame, int]:
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .withColumn("_tag", F.monotonically_increasing_id())), parts


def _starts(tagged: DataFrame, parts: int) -> tuple[list[int], int]:
    """Rows before each range partition (``parts`` numbers), and all rows."""
    bucket = F.shiftright("_tag", _POSITION_BITS).cast("int").alias("_bucket")
    sizes = dict(tagged.groupBy(bucket).count().collect())
    ends = list(accumulate(sizes.get(b, 0) for b in range(parts)))
    return [0, *ends[:-1]], ends[-1]


def global_ntile(df: DataFrame, order: Sequence[Column], n: int, alias: str = "ntile", *,
                 partitions: int | None = None) -> DataFrame:
    """``df`` with ``alias`` = NTILE(n) over ``order``.

    ``order`` must be a total order (end it with a unique column) for the
    result to be deterministic; ties are then never split arbitrarily.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged, parts = _tagged(df, list(order), partitions)
    tagged = tagged.checkpoint(eager=True)
    starts, total = _starts(tagged, parts)
    # One row per range partition: broadcast.
    offsets = spark.createDataFrame(list(enumerate(starts)), "_bucket int, _start long")
    position = F.col("_tag").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    return (tagged.withColumn("_bucket", F.shiftright("_tag", _POSITION_BITS).cast("int"))
            .join(F.broadcast(offsets), "_bucket")
            .withColumn(alias, ntile_of_rank(F.col("_start") + position + 1, total, n))
            .drop("_bucket", "_tag", "_start"))


# Rows of one rank that are sorted together at the end (some 100 kB).
BRACKET_ROWS = 4096
# Of the KLL sketch: its rank error is about 2.3 / size ** 0.9, 0.4 % here (some 25 kB).
SKETCH_SIZE = 1024
_MARGIN = 0.01
_CHUNK = 6               # bytes of a text id that one number holds


@dataclass
class _Rank:
    """A rank looked for: the rows that may hold it are those of ``where`` (SQL
    over the columns of ``_narrow``), and the row is the one at place ``offset``
    of them in order."""
    key: int
    offset: int
    where: str = "true"
    level: int = 0       # 0: the rows are ordered by the key first; from 1 on by parts of the id
    rows: int | None = None
    done: bool = False
    ranged: bool = False  # to be sorted over range partitions


def _narrow(df: DataFrame, row_id: str, keys: Sequence[Column]) -> DataFrame:
    """The keys as doubles, ``_k0`` on, and the id, ``_id``."""
    return df.select(*[k.cast("double").alias(f"_k{i}") for i, k in enumerate(keys)],
                     F.col(row_id).alias("_id"))


def _value(r: _Rank, id_type) -> str | None:
    """What the rows of a rank are ordered by: the key, then parts of the id as
    bigints in the id's order; None where the parts are used up or the type has
    none."""
    if r.level == 0:
        return f"_k{r.key}"
    if isinstance(id_type, IntegralType):
        return "CAST(_id AS BIGINT)" if r.level == 1 else None
    if isinstance(id_type, StringType) and r.level <= 64:
        part = f"substring(CAST(_id AS BINARY), {_CHUNK * (r.level - 1) + 1}, {_CHUNK})"
        return f"CAST(conv(rpad(hex({part}), {2 * _CHUNK}, '0'), 16, 10) AS BIGINT)"
    return None


def _double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _brackets(spark: SparkSession, asked: Sequence[tuple[bool, bytes, float, float]]) -> list[tuple[str, str]]:
    """Each sketch's values at two shares, as SQL literals; no job is run."""
    columns = [f"kll_sketch_get_quantile_{'bigint' if whole else 'double'}(X'{sketch.hex()}', "
               f"array({_double(low)}, {_double(high)}))" for whole, sketch, low, high in asked]
    row = spark.sql(f"SELECT {', '.join(columns)} FROM VALUES (1)").collect()[0]
    return [tuple(f"{x}L" if whole else _double(x) for x in q) for q, (whole, *_) in zip(row, asked)]


def _look(rows: DataFrame, ranks: Sequence[_Rank], id_type, sketch_size: int) -> list[tuple]:
    """For each rank its rows in question: how many, how many with a plain value,
    how many with NaN, and a sketch of the plain ones."""
    parts: dict[tuple[str, str | None], int] = {}
    columns = []
    for r in ranks:
        v = _value(r, id_type)
        i = parts.setdefault((r.where, v), len(parts))
        if i * 4 < len(columns):
            continue                                     # ranks of one order start together
        nan = f"coalesce(isnan({v}), false)" if r.level == 0 else "false"
        plain = f"CASE WHEN ({r.where}) AND NOT {nan} THEN {v} END"
        columns += [f"count_if({r.where})", f"count({plain})", f"count_if(({r.where}) AND {nan})",
                    f"kll_sketch_agg_{'bigint' if r.level else 'double'}({plain}, {sketch_size})"]
    seen = rows.selectExpr(*columns).collect()[0]
    return [seen[4 * i:4 * i + 4] for i in (parts[r.where, _value(r, id_type)] for r in ranks)]


def rows_at_ranks(df: DataFrame, row_id: str, keys: Sequence[Column], ranks_of, *,
                  bracket_rows: int = BRACKET_ROWS,
                  sketch_size: int = SKETCH_SIZE) -> list[tuple[int, float | None, object]]:
    """(number of the key, key, id) of the row at each of the ranks (from 0)
    that ``ranks_of(row count)`` names, for every key: rows in ascending order of
    that key as a double (NaN, then NULL last), then of ``row_id`` (unique, NULL
    last).

    ``df`` is read twice a round and once at the end, so it should be
    checkpointed or a cheap projection of something that is.
    """
    spark, id_type = df.sparkSession, df.schema[row_id].dataType
    rows = _narrow(df, row_id, keys)
    first = [_Rank(key, 0) for key in range(len(keys))]
    seen = _look(rows, first, id_type, sketch_size) if keys else []
    found, looks = [], []
    for r, look in zip(first, seen):
        for rank in ranks_of(look[0]):
            found.append(_Rank(r.key, rank))
            looks.append(look)
    active = list(found)
    while active:
        asked = []
        for r, (count, plain, nan, sketch) in zip(active, looks):
            r.rows = count
            v = _value(r, id_type)
            if r.rows <= bracket_rows:
                r.done = True
            elif r.offset >= plain:                     # among NaN, or NULL
                missing = r.offset >= plain + nan
                r.where = f"({r.where}) AND " + (f"{v} IS NULL" if missing else f"coalesce(isnan({v}), false)")
                r.offset -= plain + nan if missing else plain
                r.rows = count - plain - nan if missing else nan
                r.level += 1
            else:
                share, width = (r.offset + 0.5) / plain, max(_MARGIN, 1 / plain)
                asked.append((r, bytes(sketch), max(0.0, share - width), min(1.0, share + width)))
        if asked:
            regions = []
            for (r, *_), (low, high) in zip(asked, _brackets(spark, [(r.level > 0, *x) for r, *x in asked])):
                v = _value(r, id_type)
                above = f"{v} > {high}" + ("" if r.level else f" AND NOT isnan({v})")   # NaN is above all
                regions.append([f"{v} < {low}", f"{v} = {low}", f"{v} > {low} AND {v} < {high}",
                                f"{v} = {high} AND {v} > {low}", above])
            counted = rows.selectExpr(*[f"count_if(({r.where}) AND {x})" for (r, *_), region in zip(asked, regions)
                                        for x in region]).collect()[0]
            for i, (r, *_) in enumerate(asked):
                for j, region in enumerate(regions[i]):
                    n = counted[5 * i + j]
                    if r.offset < n:
                        r.where, r.rows = f"({r.where}) AND {region}", n
                        r.level += j in (1, 3)          # a tie goes on by the id
                        break
                    r.offset -= n
        for r in active:
            if not r.done:
                r.ranged = r.rows > bracket_rows and _value(r, id_type) is None
                r.done = r.rows <= bracket_rows or r.ranged
        active = [r for r in active if not r.done]
        looks = _look(rows, active, id_type, sketch_size) if active else []
    few = [r for r in found if not r.ranged]
    picked = {id(r): row for r, row in zip(few, _picked(rows, few))}
    return [(r.key, *(picked[id(r)] if id(r) in picked else _sorted_pick(rows, r))) for r in found]


def _sorted_pick(rows: DataFrame, r: _Rank) -> tuple:
    """The row of a rank among any number of rows, by a range partitioned sort."""
    key = F.col(f"_k{r.key}")
    tagged, parts = _tagged(rows.where(r.where).select(key, "_id"),
                            [key.asc_nulls_last(), F.col("_id").asc_nulls_last()], None)
    ensure_checkpoint_dir(rows.sparkSession)
    tagged = tagged.checkpoint(eager=True)
    starts, _ = _starts(tagged, parts)
    bucket = bisect_right(starts, r.offset) - 1
    tag = (bucket << _POSITION_BITS) + r.offset - starts[bucket]
    return tuple(tagged.where(F.col("_tag") == tag).select(key, "_id").first())


def _picked(rows: DataFrame, found: Sequence[_Rank]) -> list[tuple]:
    """The rows at their places among those that are left for each rank."""
    if not found:
        return []
    left = ", ".join(f"CASE WHEN {r.where} THEN struct({i} AS nth, _k{r.key} AS key) END"
                     for i, r in enumerate(found))
    places = ", ".join(str(r.offset + 1) for r in found)
    order = "struct(key IS NULL AS keyless, key, _id IS NULL AS last, _id)"
    hits = (rows.selectExpr("_id", f"inline(filter(array({left}), x -> x IS NOT NULL))")
            .groupBy("nth").agg(F.expr(f"sort_array(collect_list({order}))").alias("all"))
            .selectExpr("nth", f"element_at(all, element_at(array({places}), nth + 1)) AS hit"))
    out = {r["nth"]: (r["hit"]["key"], r["hit"]["_id"]) for r in hits.collect()}
    return [out[i] for i in range(len(found))]


def _id_literal(value, data_type) -> str:
    if value is None:
        return "NULL"
    if isinstance(data_type, StringType):
        return f"CAST(X'{value.encode().hex()}' AS STRING)"
    return f"CAST('{value}' AS {data_type.simpleString()})"


def _after(i: int, cut_key: float | None, cut_id: str) -> str:
    """Whether (key i, id) > (cut_key, cut_id), ascending, NULLs last."""
    key = "NULL" if cut_key is None else _double(cut_key)
    later_id = f"{cut_id} IS NOT NULL AND (__id IS NULL OR __id > {cut_id})"
    return (f"coalesce(__k{i} > {key} OR (__k{i} IS NULL AND {key} IS NOT NULL), false) "
            f"OR (__k{i} <=> {key} AND coalesce({later_id}, false))")


def ntile_columns(df: DataFrame, row_id: str, keys: Mapping[str, Column], n: int, *,
                  bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """``df`` with one column per entry of ``keys``: NTILE(n) over that numeric
    key ascending (as a double, NULLs last), ``row_id`` (unique) breaking ties.

    ``df`` is read for every round of ``rows_at_ranks`` and once for the result,
    so it should be checkpointed or a cheap projection of something that is.
    """
    names, columns = list(keys), df.columns
    cuts = rows_at_ranks(df, row_id, [keys[name] for name in names],
                         lambda total: [end - 1 for end in tile_ends(total, n)], bracket_rows=bracket_rows)
    id_type = df.schema[row_id].dataType
    keyed = df.withColumns({f"__k{i}": keys[name].cast("double") for i, name in enumerate(names)}
                           | {"__id": F.col(row_id)})
    tiles = {}
    for i, name in enumerate(names):
        later = [f"CAST({_after(i, key, _id_literal(cut_id, id_type))} AS BIGINT)"
                 for of, key, cut_id in cuts if of == i]
        tiles[name] = F.expr(" + ".join(["1L", *later]))
    kept = [c for c in columns if c not in tiles]
    return keyed.withColumns(tiles).select(*[F.col(f"`{c.replace('`', '``')}`") for c in kept], *names)
