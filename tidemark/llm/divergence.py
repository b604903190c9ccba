"""How far the sources of a language diverge in their vocabulary, exactly.

1. One pass over the texts counts the documents that hold each term, by
   language; terms in at least ``min_docs`` of them are kept, sorted, and
   numbered (range partitions, no group in one task).
2. The kept terms become minimal acyclic transducers whose output is a term's
   ordinal, one for each ``SEGMENT_TERMS`` consecutive terms of a language.
3. The texts are streamed through the transducers and each (language, source)
   group's terms are recounted by ordinal. One pass carries the transducers of
   at most ``PASS_TERMS`` terms, a bounded broadcast; a larger vocabulary takes
   more passes.
4. Shares are integers (billionths, smoothed, from 1 up). The divergence
   ``(p - q)^2 / (p + q)``, rounded down, is summed over all kept terms for each
   pair of sources, in blocks of terms by blocks of sources; terms that neither
   source of a pair has give the same summand each and are added as a product.

Terms are counted within a task before anything is shuffled, so that a source or
a word with a third of all rows leaves one row a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import BROADCAST_RUNS, frozen, quoted, ranked
from tidemark.llm.transducer import Transducer

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
SEGMENT_TERMS = 1 << 17
PASS_TERMS = 1 << 20
# Of the blocks in which pairs of sources are compared.
BLOCK_TERMS = 128
BLOCK_SOURCES = 64
# Counts held by a task before it gives them away, and bytes split at once.
HELD = 300_000
PIECE = 1 << 20

# Bytes of UTF-8: A-Z become lower case, every other ASCII byte but a-z parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32
                    for b in range(256))


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, a piece of the text at a time."""
    text = (text or b"").translate(_TERM_BYTES)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE) if len(text) > at + PIECE else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _plain(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    columns = [F.coalesce(c.cast("string"), F.lit("")).alias(n)
               for n, c in zip(("lang", "source"), quoted(docs, lang, source))]
    body, = quoted(docs, text)
    return docs.select(*columns, body.cast("string").cast("binary").alias("text"))


def _counted(found: dict[tuple, Counter], names: list[str]) -> pa.RecordBatch:
    """A batch of (key columns, term, n); the counts are emptied."""
    sizes = [len(c) for c in found.values()]
    keys = [pa.array(np.repeat(np.array([k[i] for k in found], dtype=object), sizes), pa.string())
            for i in range(len(names))]
    words = pa.array([w for c in found.values() for w in c], pa.binary())
    n = pa.array([x for c in found.values() for x in c.values()], pa.int64())
    found.clear()
    return pa.RecordBatch.from_arrays([*keys, words.cast(pa.string()), n], names=[*names, "term", "n"])


def document_frequencies(plain: DataFrame) -> DataFrame:
    """lang, term, n: the documents of a language that hold a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text")
            for i, lang in enumerate(langs):
                held = set()
                for piece in terms(texts[i].as_py()):
                    held.update(piece)
                found.setdefault((lang,), Counter()).update(held)
                if i % 64 == 0 and sum(map(len, found.values())) > HELD:
                    yield _counted(found, ["lang"])
        yield _counted(found, ["lang"])

    return (plain.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
            .groupBy("lang", "term").agg(F.sum("n").alias("n")))


def vocabulary(plain: DataFrame, min_docs: int = MIN_DOCS, partitions: int | None = None) -> DataFrame:
    """lang, term, rank (its ordinal, from 0), total for every kept term."""
    kept = document_frequencies(plain).where(F.col("n") >= min_docs).select("lang", "term")
    return frozen(ranked(kept, "lang", ["term"], partitions))


def transducers(vocab: DataFrame, segment_terms: int = SEGMENT_TERMS) -> DataFrame:
    """lang, segment, built (a dumped ``Transducer``); ordinals count from the
    segment's first term."""
    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        words = part.sort_values("rank")["term"]
        built = Transducer.build(w.encode() for w in words).dumps()
        return pd.DataFrame({"lang": [key[0]], "segment": [key[1]], "built": [built]})

    segment = F.floor(F.col("rank") / F.lit(segment_terms)).cast("long")
    return frozen(vocab.select("lang", segment.alias("segment"), "rank", "term")
                  .groupBy("lang", "segment")
                  .applyInPandas(build, "lang string, segment long, built binary"))


def _recounted(plain: DataFrame, carried: dict[str, list[tuple[int, bytes]]]) -> DataFrame:
    """lang, source, ordinal, n by streaming the texts through transducers; a row
    with a null ordinal marks each group, also one without terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, list[tuple[int, Transducer]]] = {}
        seen: set[tuple] = set()
        found: dict[tuple, Counter] = {}

        def numbered() -> pa.RecordBatch:
            langs, sources, places, counts = [], [], [], []
            for (lang, source), words in found.items():
                if lang not in ready:
                    ready[lang] = [(first, Transducer.loads(t)) for first, t in carried.get(lang, ())]
                named = list(words)
                n = np.fromiter(words.values(), dtype=np.int64, count=len(named))
                parts = [(np.zeros(1, np.int64) - 1, np.zeros(1, np.int64))] \
                    if (lang, source) not in seen else []
                seen.add((lang, source))
                for first, transducer in ready[lang]:
                    at = transducer.ordinals(named)
                    hit = at >= 0
                    parts.append((at[hit] + first, n[hit]))
                for at, some in parts:
                    langs += [lang] * len(at)
                    sources += [source] * len(at)
                    places.append(at)
                    counts.append(some)
            found.clear()
            place = np.concatenate(places) if places else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(sources, pa.string()),
                 pa.array(place, pa.int64(), mask=place < 0),
                 pa.array(np.concatenate(counts) if counts else place, pa.int64())],
                names=["lang", "source", "ordinal", "n"])

        for b in batches:
            keys = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()))
            texts = b.column("text")
            for i, key in enumerate(keys):
                held = found.setdefault(key, Counter())
                for piece in terms(texts[i].as_py()):
                    held.update(piece)
                if i % 64 == 0 and sum(map(len, found.values())) > HELD:
                    yield numbered()
        yield numbered()

    return plain.mapInArrow(count, "lang string, source string, ordinal long, n long")


def recount(plain: DataFrame, built: DataFrame, segment_terms: int = SEGMENT_TERMS,
            pass_terms: int = PASS_TERMS) -> DataFrame:
    """lang, source, ordinal, n: every group's occurrences of kept terms, and a
    row with a null ordinal for each group."""
    # Names of segments only: one for each ``segment_terms`` terms.
    names = sorted(map(tuple, built.select("lang", "segment").collect()))
    share = max(1, pass_terms // segment_terms)
    parts = []
    for start in range(0, max(len(names), 1), share):
        carried: dict[str, list[tuple[int, bytes]]] = {}
        chosen = names[start:start + share]
        if chosen:
            low, high = F.struct(*map(F.lit, chosen[0])), F.struct(*map(F.lit, chosen[-1]))
            this = F.struct(F.col("lang").alias("col1"), F.col("segment").alias("col2"))
            # At most ``pass_terms`` terms reach the driver and the tasks.
            for row in built.where((this >= low) & (this <= high)).collect():
                carried.setdefault(row["lang"], []).append(
                    (row["segment"] * segment_terms, bytes(row["built"])))
        parts.append(_recounted(plain, carried))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return frozen(out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def _share(n: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * kept))``, exactly."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, F.nullif(total + 2 * kept, F.lit(0)).cast("decimal(19,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _small(df: DataFrame) -> DataFrame:
    """Groups, marked for broadcast where a count shows few of them."""
    return F.broadcast(df) if df.count() <= BROADCAST_RUNS else df


def _blockwise(cells: DataFrame, groups: DataFrame, block_terms: int, block_sources: int) -> DataFrame:
    """lang, a, b (places of two sources, a < b), over: the sum, over the terms
    that either has, of the divergence less that of two absent terms."""
    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        lang, _, one, two = key
        places, row = np.unique(part["place"].to_numpy(), return_inverse=True)
        none = np.zeros(len(places), dtype=np.int64)
        none[row] = part["p0"]
        given = part["p"].to_numpy() > 0
        columns, column = np.unique(part["ordinal"].to_numpy()[given], return_inverse=True)
        p = np.repeat(none[:, None], len(columns), axis=1)
        p[row[given], column] = part["p"].to_numpy()[given]
        out = []
        for i, a in enumerate(places):
            if a // block_sources != one:
                continue
            others = np.flatnonzero((places > a) & (places // block_sources == two))
            if not len(others):
                continue
            q, q0 = p[others], none[others]
            over = ((p[i] - q) ** 2 // (p[i] + q)).sum(axis=1) \
                - (none[i] - q0) ** 2 // (none[i] + q0) * len(columns)
            out += [(lang, a, b, x) for b, x in zip(places[others], over)]
        return pd.DataFrame(out, columns=["lang", "a", "b", "over"])

    own = F.floor(F.col("place") / F.lit(block_sources)).cast("long")
    count = F.ceil(F.col("sources") / F.lit(block_sources)).cast("long")
    # Every source stands in every block of its language's terms, with p = 0, as
    # one that has none of them differs from one that has some.
    blocks = F.ceil(F.col("v") / F.lit(block_terms)).cast("long")
    present = (groups.where(F.col("v") > 0)
               .select("lang", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"), "place",
                       "sources", "p0")
               .select("lang", (F.col("_block") * block_terms).alias("ordinal"), "place", "sources",
                       F.lit(0).cast("long").alias("p"), "p0"))
    cells = cells.select(*present.columns).unionByName(present)
    # A source of one block meets every block, its own included: as many copies
    # as there are blocks, one for each part of the result that it takes part in.
    dealt = (cells.withColumn("_own", own)
             .select("lang", "ordinal", "place", "p", "p0", "_own",
                     F.explode(F.sequence(F.lit(0), count - 1)).alias("_other"))
             .select("lang", F.floor(F.col("ordinal") / F.lit(block_terms)).cast("long").alias("_terms"),
                     F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"),
                     "ordinal", "place", "p", "p0"))
    return (dealt.groupBy("lang", "_terms", "_one", "_two")
            .applyInPandas(compare, "lang string, a long, b long, over long")
            .groupBy("lang", "a", "b").agg(F.sum("over").alias("over")))


def source_divergence(docs: DataFrame, *, lang: str = "lang", source: str = "source",
                      text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP,
                      segment_terms: int = SEGMENT_TERMS, pass_terms: int = PASS_TERMS,
                      block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES,
                      partitions: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: every other source of the language, by falling divergence;
    part ``term``: the ``top`` kept terms whose share in the source exceeds that
    in its language, by falling divergence from the language. Ties go to the
    smaller item in UTF-8 order, which for terms is the smaller ordinal.

    Null texts, languages and sources count as empty strings. A language that
    keeps no term has pairs of value 0 and no terms; a source without kept terms
    has pairs. Repeated rows are documents of their own. An empty table gives no
    rows; other columns are ignored.
    """
    plain = _plain(docs, lang, source, text)
    vocab = vocabulary(plain, min_docs, partitions)
    counts = recount(plain, transducers(vocab, segment_terms), segment_terms, pass_terms)
    kept = vocab.groupBy(F.col("lang").alias("_l")).agg(F.max("total").alias("_v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = (sums.join(kept, F.col("lang") == F.col("_l"), "left")
              .select("lang", "source", "words", F.coalesce("_v", F.lit(0)).alias("v")))
    in_lang = Window.partitionBy("lang")
    groups = (ranked(groups, "lang", ["source"], partitions)
              .select("lang", "source", "v", F.col("rank").alias("place"), F.col("total").alias("sources"),
                      "words", F.sum("words").over(in_lang).alias("lang_words"))
              .withColumn("p0", _share(F.lit(0), F.col("words"), F.col("v"))))
    groups = frozen(groups)
    few = _small(groups)

    # The cells, each with its language's count of the term.
    cells = (counts.where(F.col("ordinal").isNotNull())
             .withColumn("_all", F.sum("n").over(Window.partitionBy("lang", "ordinal")))
             .join(few, ["lang", "source"])
             .select("lang", "source", "place", "sources", "ordinal", "p0",
                     _share(F.col("n"), F.col("words"), F.col("v")).alias("p"),
                     _share(F.col("_all"), F.col("lang_words"), F.col("v")).alias("q")))
    cells = frozen(cells)

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    leading = (cells.where(F.col("p") > F.col("q"))
               .select("lang", "source", "ordinal", _apart(F.col("p"), F.col("q")).alias("value"))
               .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    named = vocab.select("lang", F.col("rank").alias("ordinal"), "term")
    by_term = (leading.join(named, ["lang", "ordinal"])
               .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                       "value", "rank"))

    over = _blockwise(cells, groups, block_terms, block_sources)
    other = few.select(F.col("lang").alias("_l"), F.col("source").alias("item"),
                       F.col("place").alias("_b"), F.col("p0").alias("_q0"))
    pairs = (groups.join(other, (F.col("lang") == F.col("_l")) & (F.col("place") != F.col("_b")))
             .select("lang", "source", "item", F.least("place", "_b").alias("a"),
                     F.greatest("place", "_b").alias("b"),
                     F.coalesce(F.col("v") * _apart(F.col("p0"), F.col("_q0")), F.lit(0)).alias("_base")))
    nearest = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    by_pair = (pairs.join(over, ["lang", "a", "b"], "left")
               .select("lang", "source", F.lit("pair").alias("part"), "item",
                       (F.col("_base") + F.coalesce("over", F.lit(0))).alias("value"))
               .withColumn("rank", F.row_number().over(nearest)))
    return by_pair.unionByName(by_term)
