"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint holds, per bit, the majority over its word shingles'
64-bit hashes. Fingerprints that differ in at most ``max_bits`` bits link;
documents reachable over links form a component.

Search: the 64 bits are cut into segments so few that two linked fingerprints
differ by at most one bit in some segment. Each distinct fingerprint lies in
the table once per segment and probes it with its Hamming ball of radius one
around that segment (half of it: of two values one bit apart, the one with the
0 probes). Matches are verified on all 64 bits. Exact copies meet as one
fingerprint before any join. A segment value shared by more than ``hot_bucket``
fingerprints is split further by the same method on the remaining bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import frozen, quoted

BITS = 64
HASH_SEED = 42
HOT_BUCKET = 1024
# Shingles hashed at once, which bounds the memory a very long text takes.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), HASH_SEED)
                           for i in range(start, min(n, start + CHUNK))], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 shingle: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for every row."""
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    key, body = quoted(df, doc_id, text)
    return df.select(key.alias("doc_id"), fp(body).alias("fp"))


def _segments(width: int, max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of segments of which at least one differs by at most one bit."""
    n = max(2, max_bits // 2 + 1)
    edges = [width * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _value(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def _table(fps: DataFrame, max_bits: int) -> DataFrame:
    parts = _segments(BITS, max_bits)
    return fps.select("fp", F.posexplode(F.array(*[_value(F.col("fp"), *p) for p in parts]))
                      .alias("segment", "value"))


def _probes(fps: DataFrame, max_bits: int) -> DataFrame:
    """Each fingerprint's segment values, and those with one 0 bit set."""
    def ball(segment: int, low: int, width: int) -> Column:
        v = _value(F.col("fp"), low, width)
        flips = [F.lit(1 << b).cast("long") for b in range(width)] if max_bits else []
        return F.transform(
            F.filter(F.array(F.lit(0).cast("long"), *flips), lambda m: v.bitwiseAND(m) == 0),
            lambda m: F.struct(F.lit(segment).alias("segment"), v.bitwiseOR(m).alias("value"),
                               (m == 0).alias("same")))

    balls = [ball(i, *p) for i, p in enumerate(_segments(BITS, max_bits))]
    return fps.select("fp", F.inline(F.flatten(F.array(*balls))))


def _others(segment: Column, fp: Column, max_bits: int) -> Column:
    """A fingerprint's bits outside the segment, split like the whole was:
    an array of (part, value) structs."""
    out = None
    for i, (low, width) in enumerate(_segments(BITS, max_bits)):
        rest = BITS - width
        high = F.shiftrightunsigned(fp, low + width) if low + width < BITS else F.lit(0).cast("long")
        keep = F.shiftleft(high, low).bitwiseOR(_value(fp, 0, low) if low else F.lit(0).cast("long"))
        parts = F.array(*[F.struct(F.lit(j).alias("part"), _value(keep, lo, w).alias("rest"),
                                   F.lit(w).alias("width"))
                          for j, (lo, w) in enumerate(_segments(rest, max_bits) if rest else [])])
        out = F.when(segment == i, parts) if out is None else out.when(segment == i, parts)
    return out


def _matched(table: DataFrame, probes: DataFrame, keys: list[str], max_bits: int) -> DataFrame:
    return (probes.join(table.withColumnRenamed("fp", "other"), keys)
            .where((F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
                   & (~F.col("same") | (F.col("fp") < F.col("other"))))
            .select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")))


def near_pairs(fps: DataFrame, max_bits: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) for every two distinct fingerprints at most ``max_bits`` apart.

    ``fps`` holds distinct longs in column ``fp`` and should be a checkpoint.
    """
    if not 0 <= max_bits < BITS // 2:
        raise ValueError(f"max_bits must lie in 0 .. {BITS // 2 - 1}")
    table, probes = _table(fps, max_bits), _probes(fps, max_bits)
    keys = ["segment", "value"]
    hot = frozen(table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") > hot_bucket).select(*keys))
    if hot.isEmpty():
        return _matched(table, probes, keys, max_bits).distinct()
    found = _matched(table.join(hot, keys, "left_anti"), probes.join(hot, keys, "left_anti"),
                     keys, max_bits)
    others = _others(F.col("segment"), F.col("fp"), max_bits)
    deep_table = (table.join(hot, keys, "left_semi")
                  .select(*keys, "fp", F.inline(others)).drop("width"))
    deep_probes = (probes.join(hot, keys, "left_semi")
                   .select(*keys, "fp", "same", F.inline(others))
                   .select(*keys, "fp", "same", "part", F.explode(F.concat(
                       F.array("rest"),
                       F.transform(F.sequence(F.lit(0), F.col("width") - 1),
                                   lambda b: F.col("rest").bitwiseXOR(
                                       F.call_function("shiftleft", F.lit(1).cast("long"), b)))
                   )).alias("rest")))
    deep = _matched(deep_table, deep_probes, [*keys, "part", "rest"], max_bits)
    return found.unionByName(deep).distinct()


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                       shingle: int = 3, max_bits: int = 3,
                       hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest doc_id reachable over links, itself included.
    Words are runs of characters other than ASCII white space after A-Z are
    lower-cased; a text of fewer than ``shingle`` words is one shingle. Null
    and blank texts have fingerprint 0 and link like any other. A repeated
    doc_id keeps one row per input row; a null doc_id is never the smallest.
    Other input columns are ignored. An empty input gives no rows.
    """
    docs = frozen(fingerprints(df, doc_id, text, shingle))
    return _component_rows(docs, max_bits, hot_bucket).drop("root")


def _component_rows(docs: DataFrame, max_bits: int, hot_bucket: int) -> DataFrame:
    classes = frozen(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_pairs(classes.select("fp"), max_bits, hot_bucket), "a", "b")
    named = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = frozen(named.join(least, "root").select("fp", "component_id", "root"))
    return docs.join(ids, "fp").select(
        *[c for c in docs.columns if c != "fp"],
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def one_per_component(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                      shingle: int = 3, max_bits: int = 3,
                      hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """The input's columns, one row of each component: the one with the
    smallest doc_id (a null counts as largest; then the smallest text hash)."""
    key, body = quoted(df, doc_id, text)
    docs = frozen(fingerprints(
        df.select(F.struct(key.alias("id"), F.xxhash64(body).alias("h")).alias("key"),
                  body.alias("text")), "key", "text", shingle)
        .select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.h").alias("h"), "fp"))
    rows = _component_rows(docs, max_bits, hot_bucket)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("h"))
    keep = (rows.groupBy("root").agg(F.min(order).alias("first"))
            .select(F.col("first.doc_id").alias("keep_id"), F.col("first.h").alias("keep_h")))
    # Whole rows move once: the join and the choice among repeated rows have the
    # same keys, a null id being a flag of its own.
    def keys(doc: Column, h: Column) -> list[Column]:
        return [F.coalesce(doc.cast("string"), F.lit("")).alias("id"), doc.isNull().alias("none"),
                h.alias("h")]

    whole = df.select(F.struct("*").alias("row"), *keys(key, F.xxhash64(body)))
    kept = whole.join(keep.select(*keys(F.col("keep_id"), F.col("keep_h"))), ["id", "none", "h"], "left_semi")
    return kept.dropDuplicates(["id", "none", "h"]).select("row.*")
