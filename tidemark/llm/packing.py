"""Best-fit-decreasing packing of token sequences.

Every document is tokenised and cut where it is longer than a sequence. Pieces
are then placed longest first, each into the open sequence with the least room
that still holds it. The order among pieces of one length does not matter to
the outcome, so the placing needs only how many pieces there are of each
length (at most ``capacity`` numbers, whatever the input's size): a segment
tree over remaining capacities finds the tightest open sequences in
logarithmic time, and a run of equal pieces that goes to equal sequences is
placed in one step. The resulting runs are joined back to the pieces by length
and by the piece's rank within its length, which comes from counts per input
partition; no window or task holds the pieces of a length.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, quoted

CAPACITY = 2048
END_ID = 0
# Texts of one task that `tokenizers` encodes together, by characters.
BATCH_CHARS = 1 << 20
# Longest run without, or of, white space that tiktoken is given: its time grows
# with the square of a run.
RUN_CHARS = 1000

# What the byte-level pre-tokeniser splits by (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
# Characters whose class is the same in every Unicode table, and no long white space.
_PLAIN = "\t-\r\x20-\x7e\u00a0-\u024f"
_OTHER = re.compile(rf"[^{_PLAIN}]|\s{{{RUN_CHARS}}}")


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters for themselves, then the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Token ids as little-endian 32-bit bytes, as `tokenizers` gives them.

    Where the vocabulary allows it (``_same_ids``), tiktoken runs it at a
    fraction of the CPU time; texts with characters outside ``_PLAIN`` or with
    very long runs, or holding the string of an added token, go to `tokenizers`
    itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # `tokenizers` takes these strings out of a text before anything else.
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        ranks = self._same_ids(spec)
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def _same_ids(self, spec: dict) -> dict[bytes, int] | None:
        """The vocabulary as bytes and ids, if tiktoken gives the same ids.

        tiktoken merges the neighbours whose joined bytes have the smallest id,
        `tokenizers` those whose pair stands first in the list of merges. With
        one merge for each id, in the order of the ids, they differ only if two
        neighbours join to an entry by another pair than its own. Up to there
        the entry's bytes were merged as if they stood alone, so this cannot
        happen where every entry alone encodes to itself.
        """
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        usual = (model["type"] == "BPE" and split.get("type") == "ByteLevel"
                 and split.get("use_regex", True) and not split.get("add_prefix_space")
                 and not spec["normalizer"] and not any(model.get(k) for k in (
                     "dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        if not usual:
            return None
        vocab, alphabet = model["vocab"], _byte_alphabet()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab[m] for m in merged]
        entries = set(alphabet).union(merged)
        if ids != sorted(set(ids)) or not entries.issubset(vocab):
            return None
        tokenize = self.slow.model.tokenize
        if not all(len(tokenize(e)) == 1 for e in entries):
            return None
        return {bytes(alphabet[c] for c in e): vocab[e] for e in entries}

    def _runs_fast(self, text: str) -> bool:
        return (self.fast is not None and not any(t in text for t in self.added)
                and not _OTHER.search(text)
                and max(map(len, text.split()), default=0) <= RUN_CHARS)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        slow = [t for t in texts if not self._runs_fast(t)]
        others = iter(self.slow.encode_batch_fast(slow, add_special_tokens=False)) if slow else iter(())
        ask = iter(slow)
        waiting = next(ask, None)
        for text in texts:
            if text is waiting:
                waiting = next(ask, None)
                yield np.array(next(others).ids, dtype="<u4").tobytes()
            else:
                yield self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@functools.cache
def _encoder(path: str) -> Encoder:
    """Kept for the next tasks of a Python worker."""
    return Encoder(path)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, the first
    piece taking what is left over."""
    first = length % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, length, capacity)]


def token_pieces(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *,
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, rank for every piece.

    ``part`` is the task's number and ``rank`` the piece's among those of its
    length in the task; fix the result before using them together.
    """
    key, body = quoted(df, doc_id, text)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, ranks = _encoder(tokenizer), [0] * (capacity + 1)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            ids, at = batch["id"].array, 0
            rows = []
            while at < len(texts):
                stop, chars = at, 0
                while stop < len(texts) and (stop == at or chars + len(texts[stop]) <= BATCH_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                for doc, tokens in zip(range(at, stop), encoder.encode(texts[at:stop])):
                    tokens += end
                    for n, (start, length) in zip(count(), cut(len(tokens) // 4, capacity)):
                        crc = zlib.crc32(tokens[4 * start:4 * (start + length)])
                        rows.append((doc, n, start, length, crc, ranks[length]))
                        ranks[length] += 1
                at = stop
            made = pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids_crc32", "rank"])
            made.insert(0, "id", ids.take(made.pop("doc").to_numpy(dtype=np.int64)))
            yield made

    kind = df.schema[doc_id].dataType.simpleString()
    return (df.select(key.alias("id"), body.alias("text"))
            .mapInPandas(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long, rank long")
            .select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                    F.spark_partition_id().alias("part"), "rank"))


class _Rooms:
    """Segment tree over remaining capacities: which hold open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def put(self, room: int, filled: bool) -> None:
        i = room + self.size
        self.tree[i] = int(filled)
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest marked capacity of at least ``least``."""
        i = least + self.size
        while not self.tree[i]:
            while i % 2:  # climb until there is a right neighbour
                i //= 2
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i + (not self.tree[2 * i])
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``counts[length]`` pieces, as runs.

    A run (length, rank, pieces, sequence, per, fill) puts the pieces of that
    length ranked from ``rank`` into sequences numbered from ``sequence``,
    ``per`` in each, from place ``fill`` on.
    """
    rooms, runs, opened = _Rooms(capacity), [], 0
    # Open sequences by room: [first sequence, how many] each.
    held: dict[int, list[list[int]]] = {}

    def hold(room: int, first: int, many: int) -> None:
        if many and room:
            held.setdefault(room, []).append([first, many])
            rooms.put(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                room, first = capacity, opened
                many = -(-left // (capacity // length))
                opened += many
            else:
                first, many = held[room].pop()
                if not held[room]:
                    rooms.put(room, False)
            per = room // length
            full = min(many, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - room))
                hold(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < many:
                if left:  # fewer than ``per``: the last ones share a sequence
                    runs.append((length, rank, left, first + full, left, capacity - room))
                    hold(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                hold(room, first + full, many - full)
    return runs


def pack_documents(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *,
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every
    piece of every row.

    A null or empty text is the end id alone. Rows that repeat a doc_id are
    packed each on its own. Other input columns are ignored. An empty input
    gives no rows.
    """
    pieces = frozen(token_pieces(df, tokenizer, doc_id, text, capacity=capacity, end_id=end_id))
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = frozen(per_part.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))))
    # One number per length: at most ``capacity`` of them.
    counts = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = df.sparkSession.createDataFrame(
        best_fit(counts, capacity),
        "length long, rank long, pieces long, sequence long, per long, fill long")
    # At most ``capacity`` rows.
    runs = F.broadcast(runs.groupBy("length").agg(F.array_sort(F.collect_list(
        F.struct("rank", "pieces", "sequence", "per", "fill"))).alias("runs")))
    placed = (pieces.join(starts.select("part", "length", "ahead"), ["part", "length"])
              .join(runs, "length")
              .withColumn("nth", F.col("ahead") + F.col("rank"))
              .withColumn("run", F.get(F.filter(
                  "runs", lambda r: (r["rank"] <= F.col("nth"))
                  & (F.col("nth") < r["rank"] + r["pieces"])), F.lit(0))))
    turn = F.col("nth") - F.col("run.rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.floor(turn / F.col("run.per"))).alias("sequence_id"),
        (F.col("run.fill") + F.pmod(turn, F.col("run.per")) * F.col("length")).alias("offset"))
