"""License scan: templates retrieved by MinHash bands over text windows, then
verified by exact shingle containment.

A text's word shingles are cut into blocks; a window is two neighbouring
blocks. For a template the blocks hold at least 1.25 times its shingles, so
some window holds every occurrence whole, and the Jaccard similarity of the
two is bounded from below. With bands of one MinHash value each, as many are
used as make a collision at that similarity all but certain (``miss``). A
window that shares a band with a template is checked exactly: the share of the
template's shingles that it holds must be ``containment`` or more.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm.frames import quoted
from tidemark.llm.license_texts import TEMPLATES

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
# Shingles of several texts scanned together, and words remembered, by one task.
CHUNK = 1 << 18
MEMO_WORDS = 400_000
# The last bits of a band value by which most windows are passed over.
ENDS = np.uint32((1 << 13) - 1)
WORD = re.compile(r"\w+")


class Shingles:
    """Hashed word shingles of texts; words are lower-cased runs of letters,
    digits and underscores."""

    def __init__(self, size: int):
        self.size, self.memo = size, {}

    def _code(self, word: str) -> int:
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        code = self.memo[word] = zlib.crc32(word.encode("utf-8", "replace")) + 1
        return code

    def of(self, text: str | None) -> np.ndarray:
        """One hash for each shingle in order; of fewer words than a shingle,
        one for all; none without words."""
        words = WORD.findall(text.lower()) if text else []
        known = self.memo.get
        codes = np.fromiter((known(w) or self._code(w) for w in words), dtype=np.uint64, count=len(words))
        size = min(self.size, len(codes))
        if not size:
            return codes
        out = np.zeros(len(codes) - size + 1, dtype=np.uint64)
        for i in range(size):
            out = (out + codes[i:i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out


def bands_needed(similarity: float, miss: float = MISS) -> int:
    """Bands of one value each: as many as leave a pair of this similarity
    without a collision with probability ``miss`` at most."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


class Scanner:
    """Templates with an index of their band values: for each window size and
    band, the templates sorted by value, so that a window finds those that share
    its value by binary search, if the value's last bits are any template's."""

    def __init__(self, templates: Mapping[str, str], shingle: int = SHINGLE,
                 containment: float = CONTAINMENT, miss: float = MISS, seed: int = 11):
        self.shingles, self.containment, self.shingle = Shingles(shingle), containment, shingle
        self.names = list(templates)
        self.sets = [np.unique(self.shingles.of(t)) for t in templates.values()]
        if not all(map(len, self.sets)):
            raise ValueError("a template needs at least one word")
        # Blocks of a power of two, so that smaller ones add up to larger ones.
        self.block = [1 << math.ceil(math.log2(1.25 * len(s))) for s in self.sets]
        similarity = [containment * len(s) / (2 * b + (1 - containment) * len(s))
                      for s, b in zip(self.sets, self.block)]
        bands = [bands_needed(x, miss) for x in similarity]
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 31, max(bands, default=1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.least = min(self.block, default=1)
        # (block, band): values in order, their templates, and which last bits occur.
        self.index: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for block in sorted(set(self.block)):
            for band in range(len(self.odd)):
                mine = [t for t, (own, n) in enumerate(zip(self.block, bands)) if own == block and band < n]
                if mine:
                    marks = np.array([self._values(self.sets[t], band).min() for t in mine])
                    order = np.argsort(marks, kind="stable")
                    ends = np.zeros(int(ENDS) + 1, dtype=bool)
                    ends[marks & ENDS] = True
                    self.index[block, band] = marks[order], np.array(mine)[order], ends

    def _values(self, shingles: np.ndarray, band: int) -> np.ndarray:
        v = (shingles >> np.uint64(32)).astype(np.uint32) * self.odd[band]
        v ^= v >> np.uint32(15)
        return v * self.odd[band]

    def scan(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, int, int, float]]:
        """(text's number, template, first word, words, containment) of each
        place found; places of a template that overlap are one, with the best
        containment."""
        held, length = [], 0
        for n, text in enumerate(texts):
            shingles = self.shingles.of(text)
            if len(shingles):
                held.append((n, shingles))
                length += len(shingles)
            if length >= CHUNK:
                yield from self._found(held)
                held, length = [], 0
        if held:
            yield from self._found(held)

    def _levels(self, sizes: np.ndarray) -> dict[int, tuple]:
        """Per block size: each block's left and right part among the blocks of
        half the size, the block after it in its text (the last one's is itself),
        and where the texts' blocks begin. A text has at least one block."""
        levels, block, many = {}, self.least, -(-sizes // self.least)
        left = right = None
        while True:
            ends = np.cumsum(many)
            first = ends - many
            after = np.arange(1, ends[-1] + 1)
            after[ends - 1] -= 1
            levels[block] = left, right, after, first
            if block >= max(self.block):
                return levels
            above = -(-many // 2)
            text = np.repeat(np.arange(len(above)), above)
            inside = np.arange(len(text)) - np.repeat(np.cumsum(above) - above, above)
            left = first[text] + 2 * inside
            right = after[left]
            many, block = above, 2 * block

    def _candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(text, template, block number) of the windows that share a band value
        with a template."""
        # Whole blocks of the smallest size: a text's last shingle is repeated.
        pads = [np.concatenate([t, np.full(-len(t) % self.least, t[-1])]) for t in texts]
        shingles = np.concatenate(pads)
        levels = self._levels(np.array([len(t) for t in texts]))
        many = len(shingles) // self.least
        met: dict[int, list[np.ndarray]] = {block: [] for block in levels}
        for band in range(len(self.odd)):
            least = self._values(shingles, band)
            while len(least) > many:
                least = np.minimum(least[0::2], least[1::2])
            for block, (left, right, after, _) in levels.items():
                if left is not None:
                    least = np.minimum(least[left], least[right])
                if (block, band) not in self.index:
                    continue
                marks, templates, ends = self.index[block, band]
                window = np.minimum(least, least[after])
                some = np.flatnonzero(ends[window & ENDS])
                low, high = (np.searchsorted(marks, window[some], side) for side in ("left", "right"))
                for i in np.flatnonzero(low < high):
                    met[block].append(templates[low[i]:high[i]] * len(window) + some[i])
        for block, found in met.items():
            if found:
                _, _, after, first = levels[block]
                template, at = np.divmod(np.unique(np.concatenate(found)), len(after))
                text = np.searchsorted(first, at, "right") - 1
                yield from zip(text.tolist(), template.tolist(), (at - first[text]).tolist())

    def _found(self, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, str, int, int, float]]:
        texts = [shingles for _, shingles in held]
        places: dict[tuple[int, int], list] = {}
        for text, template, at in self._candidates(texts):
            block = self.block[template]
            place = self._verified(texts[text], at * block, 2 * block, self.sets[template])
            if place:
                places.setdefault((template, text), []).append(place)
        for (template, text), found in sorted(places.items()):
            for place in _joined(found):
                yield (held[text][0], self.names[template], *place)

    def _verified(self, shingles: np.ndarray, start: int, size: int, wanted: np.ndarray):
        window = shingles[start:start + size]
        at = np.flatnonzero(np.isin(window, wanted))
        share = len(np.unique(window[at])) / len(wanted)
        if share < self.containment:
            return None
        return start + int(at[0]), int(at[-1] - at[0]) + self.shingle, share


def _joined(places: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    for start, words, share in sorted(places):
        if out and start < out[-1][0] + out[-1][1]:
            first, length, best = out[-1]
            out[-1] = (first, max(length, start + words - first), max(best, share))
        else:
            out.append((start, words, share))
    return out


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *,
                  templates: Mapping[str, str] = TEMPLATES, shingle: int = SHINGLE,
                  containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """doc_id, template, first_word, words, containment for each place of a
    text that holds a template; a document without any has no row.

    Texts are scanned whole, each row on its own (repeated rows give repeated
    results). Null, empty and wordless texts hold nothing. A narrow pass: no
    shuffle. Other columns are ignored; an empty input gives no rows.
    """
    key, body = quoted(df, doc_id, text)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, shingle, containment, miss)
        for batch in batches:
            ids, rows = batch["id"].array, list(scanner.scan(batch["text"]))
            out = pd.DataFrame(rows, columns=["n", "template", "first_word", "words", "containment"])
            out.insert(0, "doc_id", ids.take(out.pop("n").to_numpy(dtype=np.int64)))
            yield out

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(key.alias("id"), body.alias("text")).mapInPandas(
        scan, f"doc_id {kind}, template string, first_word long, words long, containment double")
