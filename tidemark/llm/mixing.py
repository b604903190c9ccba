"""Mixing sources to target weights, in DataFrame and SQL functions only.

A source's words, laid end to end in row order, are cut into blocks of
``block_words``. The mix is a line of slots, ``shard_slots`` per output shard;
each shard draws multinomial counts of its slots over the sources, and what
the draws give a source above its quota goes to the sources below theirs, so
the mix as a whole hits the quotas. A source's slots are numbered through; slot
number k is in pass ``k div blocks`` over the source, and each pass walks the
blocks in its own pseudorandom permutation. Block numbers are joined to the
documents that the blocks overlap.

Rows of one source are numbered by sums over (source, input partition, chunk)
first, so no window holds more than a chunk's rows or a source's partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import (
    frozen,
    permuted,
    place_index,
    place_partition,
    quoted,
    running_sums,
    stored,
)

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_TAKES = 3
CHUNK_ROWS = 1024
BROADCAST_SOURCES = 50_000
CELL = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3),
                   max_takes: int = MAX_TAKES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its number by code point
    (null last), source_size, target, blocks and quota (slots of the mix).

    Weights repeat over the sources. Targets share the total size by weight; a
    source whose share passes ``max_takes`` times its size stops there and the
    rest is shared anew. Sources ordered by that limit per weight are capped up
    to some place in the order, so running sums give the common level. No task
    holds all sources.
    """
    per = frozen(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    per = running_sums(per, [F.col("source").asc_nulls_last()], {"number": F.lit(1).cast("long")})
    per = per.withColumn("weight", F.get(wheel, F.col("number") % len(weights)))
    limit = (F.col("source_size") * max_takes).cast("double")
    per = frozen(per.withColumn("limit", limit).withColumn("ratio", limit / F.col("weight")))
    per = running_sums(per, ["ratio", "number"], {
        "limits": F.col("limit"), "weights": F.col("weight"), "sizes": F.col("source_size")})
    limit = F.col("limit")
    per = frozen(per.withColumn("level", (F.col("sizes_all") - F.col("limits"))
                                / (F.col("weights_all") - F.col("weights"))))
    # The first source in the order that stays under its limit sets the level.
    under = F.when(limit > F.col("level") * F.col("weight"), F.struct("ratio", "number"))
    level = per.agg(F.coalesce(F.min_by("level", under), F.lit(float("inf")))).scalar()
    per = per.withColumn("target", F.least(limit, level * F.col("weight")))
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.round(F.col("target") * blocks / F.nullif(F.col("source_size"), F.lit(0)))
    return per.select(
        "source", F.col("number").cast("long").alias("number"), "source_size", "target",
        blocks.alias("blocks"),
        F.least(F.coalesce(quota, F.lit(0.0)).cast("long"), blocks * max_takes).alias("quota"))


def _offsets(rows: DataFrame) -> DataFrame:
    """rows (place, number, size) with ``start``: words of the source before the row."""
    rows = rows.withColumn("part", place_partition(F.col("place"))) \
               .withColumn("chunk", F.floor(place_index(F.col("place")) / CHUNK_ROWS))

    def before(*by: str):
        return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)

    def running(df: DataFrame, size: str, name: str, *by: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(F.sum(size).over(before(*by)), F.lit(0).cast("long")))

    chunks = rows.groupBy("number", "part", "chunk").agg(F.sum("size").alias("words"))
    parts = chunks.groupBy("number", "part").agg(F.sum("words").alias("part_words"))
    chunks = running(chunks, "words", "chunk_start", "number", "part", "chunk")
    parts = running(parts, "part_words", "part_start", "number", "part")
    starts = chunks.join(parts, ["number", "part"]).select(
        "number", "part", "chunk", (F.col("chunk_start") + F.col("part_start")).alias("base"))
    return (running(rows, "size", "ahead", "number", "part", "chunk", "place")
            .join(starts, ["number", "part", "chunk"])
            .select("place", "number", "size", (F.col("base") + F.col("ahead")).alias("start")))


def _slots(sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(number, blocks, k): every slot of the mix as a source and the slot's
    number within the source, each source having exactly its quota of them.

    Sources are rows throughout: their quotas, laid end to end, are intervals
    of a line, and a draw is a point on it (``_met``).
    """
    spark = sources.sparkSession
    many, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    few = many <= BROADCAST_SOURCES
    slot = F.col("id")
    points = spark.range(total).select(
        F.floor(slot / shard_slots).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), slot), F.lit(max(total, 1))).alias("point"))
    line = running_sums(sources.select("number", F.col("quota").alias("width")), ["number"],
                        {"low": F.col("width")})
    counts = frozen(_met(points, line, many, total)
                    .groupBy("shard", "number").agg(F.count(F.lit(1)).alias("n")))
    # Slots of a source before this shard: over groups of shards, then within.
    group = F.floor(F.col("shard") / CHUNK_ROWS)
    shards = counts.withColumn("group", group)
    groups = shards.groupBy("number", "group").agg(F.sum("n").alias("m")).withColumn(
        "base", F.coalesce(F.sum("m").over(Window.partitionBy("number").orderBy("group").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("m")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("number", "group").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    numbered = (shards.withColumn("ahead", first).join(groups, ["number", "group"])
                .select("number", (F.col("base") + F.col("ahead")).alias("first"), "n"))
    # Draws above a source's quota, in one line, fill those below theirs.
    got = counts.groupBy("number").agg(F.sum("n").alias("got"))
    none = F.lit(0).cast("long")
    balance = frozen(sources.select("number", "quota", "blocks").join(got, "number", "left")
                     .withColumn("got", F.coalesce("got", none))
                     .withColumn("over", F.greatest(F.col("got") - F.col("quota"), none))
                     .withColumn("width", F.greatest(F.col("quota") - F.col("got"), none)))
    balance = frozen(running_sums(balance, ["number"], {"over_from": F.col("over"), "low": F.col("width")}))
    own = balance.select("number", "quota", "blocks", "over_from")
    # Few rows of counts make many slots: deal the counts to all tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = frozen(numbered.join(F.broadcast(own) if few else own, "number")
                      .repartition(tasks, "number", "first"))
    first, end, quota = F.col("first"), F.col("first") + F.col("n"), F.col("quota")
    kept = numbered.where(first < quota).select("number", "blocks", F.explode(
        F.sequence(first, F.least(end, quota) - 1)).alias("k"))
    spare = numbered.where(end > quota).select(
        F.explode(F.sequence(F.greatest(first, quota), end - 1)).alias("k"), "over_from", "quota")
    spare = spare.select((F.col("over_from") + F.col("k") - quota).alias("point"))
    short = balance.agg(F.coalesce(F.sum("width"), F.lit(0))).first()[0]
    given = _met(spare, balance.select("number", "blocks", "got", "width", "low"), many, short)
    return kept.unionByName(given.select(
        "number", "blocks", (F.col("got") + F.col("point") - F.col("low")).alias("k")))


def _met(points: DataFrame, line: DataFrame, many: int, length: int) -> DataFrame:
    """``points`` with the row of ``line`` (``many`` rows, end to end over
    ``0 .. length-1``: low, width) whose interval holds ``point``.

    The line is cut into equal cells, and an interval is a row for each cell
    that it meets. Where the intervals may be broadcast there are as many cells
    as intervals, so a point meets two rows of the line on average; more of them
    are joined by cell, ``CELL`` points wide.
    """
    few = many <= BROADCAST_SOURCES
    cell = max(1, length // max(1, many)) if few else CELL
    low, end = F.col("low"), F.col("low") + F.col("width")

    def number(at: Column) -> Column:
        return F.floor(at / cell)

    cells = line.where(F.col("width") > 0).withColumn(
        "cell", F.explode(F.sequence(number(low), number(end - 1))))
    return (points.withColumn("cell", number(F.col("point")))
            .join(F.broadcast(cells) if few else cells, "cell")
            .where((low <= F.col("point")) & (F.col("point") < end)).drop("cell"))


def taken_spans(rows: DataFrame, sources: DataFrame, *, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """(place, from, words, times): spans of a row's words that the mix takes.

    ``rows`` has place, number (its source's) and size.
    """
    number, k, blocks = F.col("number"), F.col("k"), F.col("blocks")
    chosen = (_slots(sources, shard_slots, seed)
              .select("number", permuted(
                  F.pmod(k, blocks), blocks,
                  F.xxhash64(F.lit(seed), number, F.floor(k / blocks))).alias("block"))
              .groupBy("number", "block").agg(F.count(F.lit(1)).alias("times")))
    start, size = F.col("start"), F.col("size")
    met = (_offsets(rows).where(size > 0)
           .select("place", "number", "start", "size", F.explode(F.sequence(
               F.floor(start / block_words), F.floor((start + size - 1) / block_words)))
               .alias("block")))
    low = F.greatest(F.col("block") * block_words, start)
    high = F.least((F.col("block") + 1) * block_words, start + size)
    return met.join(chosen, ["number", "block"]).select(
        "place", (low - start).alias("from"), (high - low).alias("words"), "times")


def _numbered(df: DataFrame, weights, max_takes: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """(rows with place, number, size; sources), both fixed by a checkpoint.
    ``df`` has place, source, size. The source table is broadcast while it
    is counted small; a larger one is joined by a shuffle."""
    sources = frozen(source_targets(df, weights, max_takes, block_words))
    names = sources.select(F.col("source").alias("name"), "number", "source_size", "target")
    if sources.count() <= BROADCAST_SOURCES:
        names = F.broadcast(names)
    rows = df.join(names, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    return rows, sources


def mix_sources(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", *, weights: Sequence[float] = (1, 2, 3),
                max_takes: int = MAX_TAKES, block_words: int = BLOCK_WORDS,
                shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row.

    size: words of the text (0 for a null); target: words the row's source
    gives the mix; taken: words the mix takes from the row, repeats counted.
    A block is taken at most ``max_takes`` times, and so is every word. Rows
    without words take nothing; a null source is a source of its own; repeated
    rows are separate rows. Input columns other than the three are ignored. An
    empty input gives no rows.
    """
    key, body, name = quoted(df, doc_id, text, source)
    base = frozen(df.select(F.monotonically_increasing_id().alias("place"), key.alias("doc_id"),
                            name.alias("source"), word_count(body).alias("size")))
    rows, sources = _numbered(base, weights, max_takes, block_words)
    taken = (taken_spans(rows.select("place", "number", "size"), sources, block_words=block_words,
                         shard_slots=shard_slots, seed=seed)
             .groupBy("place").agg(F.sum(F.col("words") * F.col("times")).alias("taken")))
    return (rows.join(taken, "place", "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0).cast("long")).alias("taken")))


def mixed_documents(df: DataFrame, text: str = "text", source: str = "source",
                    n_chars: str | None = "n_chars", *, weights: Sequence[float] = (1, 2, 3),
                    max_takes: int = MAX_TAKES, block_words: int = BLOCK_WORDS,
                    shard_slots: int = SHARD_SLOTS, seed: int = 17) -> DataFrame:
    """The input's columns, one row for each row the mix takes words from, with
    the text the mix takes of it.

    Where every word is taken once, the text stays as it is; otherwise it is
    the taken spans' words, joined by spaces, as often as the mix takes them
    (first copy whole, then the second, then the third). ``n_chars`` follows
    the text if that column exists.
    """
    body, name = quoted(df, text, source)
    whole = stored(df.select(F.monotonically_increasing_id().alias("place"),
                             F.struct("*").alias("row"), name.alias("source"),
                             body.alias("text"), word_count(body).alias("size")))
    rows, sources = _numbered(whole.select("place", "source", "size"), weights, max_takes, block_words)
    spans = (taken_spans(rows.select("place", "number", "size"), sources, block_words=block_words,
                         shard_slots=shard_slots, seed=seed)
             .groupBy("place").agg(
                 F.sum(F.col("words") * F.col("times")).alias("taken"), F.max("times").alias("most"),
                 F.array_sort(F.collect_list(F.struct("from", "words", "times"))).alias("spans")))

    def mixed(words: Column) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.col("most")), lambda c: F.array_join(
            F.flatten(F.transform(
                F.filter("spans", lambda s: s["times"] >= c),
                lambda s: F.slice(words, (s["from"] + 1).cast("int"), s["words"].cast("int")))),
            " ")), " ")

    once = (F.col("taken") == F.col("size")) & (F.col("most") == 1)
    # One element, so that the spans see the words, not the expression that finds them.
    all_words = F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    out = whole.join(spans, "place").select(
        "row", F.when(once, F.col("text")).otherwise(F.get(F.transform(all_words, mixed), F.lit(0))).alias("mixed"))
    changed = {text: F.col("mixed")}
    if n_chars is not None and n_chars in df.columns:
        changed[n_chars] = F.length("mixed").cast(df.schema[n_chars].dataType)
    return out.select(*[changed[c].alias(c) if c in changed else
                        F.col("row").getField(c).alias(c) for c in df.columns])
