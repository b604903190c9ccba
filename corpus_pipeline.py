"""A training corpus from raw documents, in four stages.

Each stage is (spark, docs, sf_dir) -> DataFrame, written as Parquet and read
again as the next one's ``docs``; the last one's rows are the packed sequences.
``ORACLE_SQL`` is None: hashing shingles, fitting a model and tokenising have
no SQL form, so tests hold each stage against a brute-force version.

Every stage returns no rows for an empty table. Null and empty texts are scored,
fingerprinted (as 0, so that one of them stays) and then left out by the mix,
which takes no word of them; a repeated row stays once at most; columns beside
``doc_id``, ``text``, ``source`` and ``n_chars`` pass through untouched. Two columns
whose names differ in case only (``TEXT`` beside ``text``) are an error, as Spark
cannot tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality, simhash
from tidemark.llm.frames import read, remove, scratch, stored
from tidemark.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: score 0.3 or more.
    Empty texts get the model's intercept, as any text without features."""
    return quality.keep_quality(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest doc_id (a
    null id counts as the largest)."""
    return simhash.one_per_component(docs, shingle=3, max_bits=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; documents of which it takes
    none, such as null and empty ones, go. A null source is a source of its own."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("near_dedup", drop_near_copies), ("mixing", mix),
          ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A stage's table is removed once the next one is written;
    the last stage's input stays, since its rows are read lazily."""
    docs, last = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as paths:
            docs = stored(stage(spark, docs, sf_dir))
            written = paths.pop()
        if last:
            remove(spark, last)
        last = written
    return STAGES[-1][1](spark, docs, sf_dir)
