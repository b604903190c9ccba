"""Quality classifier: a linear model over naive-Bayes-scaled n-grams.

Features are presence indicators of hashed n-grams: words and word pairs, and
runs of one to three word shapes (case, digits, closing punctuation, repeated
word). Each indicator is scaled by its class log-count ratio and rows are
brought to unit length; a linear hinge-loss model is fitted by dual coordinate
descent, and its margins are mapped to probabilities by a logistic curve.

The fit takes at most ``train_rows`` labelled ids, chosen by a hash of the id,
one row of features each, and of these at most ``train_features`` features
(documented bounds: what the fit's one task holds); scoring is one narrow pass
over whole texts with the fixed-size weight vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import frozen, quoted

BUCKETS = 1 << 18
TRAIN_ROWS = 12_000
# Features of all rows of the fit together (4 bytes each, 12 while it runs).
TRAIN_FEATURES = 50_000_000
THRESHOLD = 0.3
# Words read at once, and words remembered, by one task.
CHUNK_WORDS = 1 << 17
MEMO_WORDS = 400_000


class Ngrams:
    """Hashed n-gram indicators of texts; words met before are remembered."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = np.uint64(buckets - 1)
        self.memo: dict[str, int] = {}

    def _code(self, word: str) -> int:
        """Low half: the word's hash; high half: its shape's."""
        core = word.rstrip("!?.,;:$%&*#|@~^=+<>()[]{}\"'")
        case = ("U" if core.isupper() and len(core) > 1 else "C" if core[:1].isupper() else "l") \
            if any(c.isalpha() for c in core) else "-"
        tail = word[len(core):]
        shape = f"{case}{any(c.isdigit() for c in core):d}{tail[:1]}{min(len(tail), 3)}"
        code = zlib.crc32(word.lower().encode("utf-8", "replace")) \
            | zlib.crc32(shape.encode("utf-8", "replace")) << 32
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = code
        return code

    def _codes(self, words: list[str]) -> np.ndarray:
        known = self.memo.get
        return np.fromiter((known(w) or self._code(w) for w in words), dtype=np.uint64,
                           count=len(words))

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct feature numbers; none for an empty text."""
        words = (text or "").split()
        found = []
        for start in range(0, len(words), CHUNK_WORDS):
            code = self._codes(words[max(0, start - 2):start + CHUNK_WORDS])
            word, shape = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
            same = np.zeros(len(code), dtype=np.uint64)
            same[1:] = word[1:] == word[:-1]
            shape = shape * np.uint64(2) + same
            grams = [word, word[:-1] * np.uint64(0x9E3779B1) + word[1:] + np.uint64(1),
                     shape + np.uint64(2 << 40)]
            pair = shape[:-1] * np.uint64(0x85EBCA6B) + shape[1:]
            grams += [pair + np.uint64(3 << 40),
                      pair[:-1] * np.uint64(0xC2B2AE35) + shape[2:] + np.uint64(5 << 40)]
            mixed = np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)
            found.append(np.unique((mixed >> np.uint64(40)) & self.buckets))
        if not found:
            return np.zeros(0, dtype=np.int64)
        return (found[0] if len(found) == 1 else np.unique(np.concatenate(found))).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, *, cost: float = 1.0,
        epochs: int = 12, smoothing: float = 1.0, seed: int = 7) -> dict:
    """The model of rows (arrays of feature numbers) with labels 0 and 1.

    ``weights`` and ``squares`` have an entry per feature: a row's margin is
    its weights' sum over the root of its squares' sum, and the probability of
    label 1 is ``1 / (1 + exp(-(slope * margin + intercept)))``.

    With rows of one class only (or none) the weights are 0 and the intercept
    gives that class's smoothed share.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    positive, negative = np.full(buckets, smoothing), np.full(buckets, smoothing)
    for x, label in zip(rows, y):
        (positive if label > 0 else negative)[x] += 1
    share = (np.sum(y > 0) + 1) / (len(y) + 2)
    ratio = np.log(positive / positive.sum()) - np.log(negative / negative.sum())
    if not len(y) or abs(y.sum()) == len(y):
        return {"weights": np.zeros(buckets), "squares": np.zeros(buckets), "slope": 0.0,
                "intercept": float(np.log(share / (1 - share)))}
    # Rows scaled by the ratios, at unit length.
    scaled = []
    for x in rows:
        v = ratio[x]
        norm = np.sqrt(v @ v)
        scaled.append(v / norm if norm > 0 else v)
    # Each class carries half of the loss.
    bound = np.where(y > 0, cost / (2 * np.mean(y > 0)), cost / (2 * np.mean(y < 0)))
    w, alpha, rng = np.zeros(buckets), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], scaled[i]
            if not len(x):
                continue
            gradient = y[i] * (w[x] @ v) - 1
            new = min(max(alpha[i] - gradient, 0.0), bound[i])
            if new != alpha[i]:
                w[x] += (new - alpha[i]) * y[i] * v
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    margins = np.array([w[x] @ v for x, v in zip(rows, scaled)])
    slope, intercept = _logistic(margins, y)
    return {"weights": w * ratio, "squares": ratio * ratio, "slope": slope,
            "intercept": intercept}


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the margins (Newton's method, smoothed targets)."""
    n1, n0 = np.sum(y > 0), np.sum(y < 0)
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    beta, x = np.array([1.0, 0.0]), np.stack([margins, np.ones_like(margins)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows never learned from: crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality", train_rows: int = TRAIN_ROWS,
          train_features: int = TRAIN_FEATURES, folds: int = 5) -> dict:
    """The model (see ``fit``), fitted on at most ``train_rows`` labelled
    ids outside the held-out fold, with at most ``train_features`` features
    together: in the order of the ids' hashes, up to that sum.

    A document labelled more than once counts by its mean label (an even split
    is left out); null ids and labels are ignored. An id that stands in several
    rows counts once, by one of its texts. The sample is the rows whose
    hashed id falls under a limit set by the label count, so it is the same in
    every run; its ids are small enough to broadcast by that bound.
    """
    lid, mark = quoted(labels, doc_id, label)
    known = (labels.select(lid.alias("id"), mark.cast("double").alias("y"))
             .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id"), folds))
             .groupBy("id").agg(F.avg("y").alias("y")).where(F.col("y") != 0.5))
    count = known.count()
    # 5 % below the bound, so that chance does not pass it.
    share = min(1.0, 0.95 * train_rows / max(count, 1))
    place = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1 << 20))
    sample = known.where(place < F.lit(int(share * (1 << 20)))) if share < 1 else known
    key, body = quoted(docs, doc_id, text)
    rows = (docs.select(key.alias("id"), body.alias("text"))
            .join(F.broadcast(sample), "id").select("id", "text", (F.col("y") > 0.5).cast("int").alias("y")))
    id_type = rows.schema["id"].dataType.simpleString()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Ngrams()
        for part in batches:
            yield pd.DataFrame({"id": part["id"],
                                "x": [grams.of(t).astype("<i4").tobytes() for t in part["text"]],
                                "y": part["y"]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        xs = [x for p in parts for x in p["x"]]
        ys = np.concatenate([p["y"].to_numpy() for p in parts]) if parts else np.zeros(0)
        # One order whatever task gave the rows.
        order = sorted(range(len(xs)), key=lambda i: (xs[i], ys[i]))
        model = fit([np.frombuffer(xs[i], dtype="<i4") for i in order], ys[order])
        yield pd.DataFrame([model | {k: model[k].astype("<f8").tobytes()
                                     for k in ("weights", "squares")}])

    # One row an id, combined before the shuffle: the least feature list.
    known_rows = frozen(rows.mapInPandas(features, f"id {id_type}, x binary, y int")
                        .groupBy("id").agg(F.min("x").alias("x"), F.first("y").alias("y"))
                        .select("x", "y", F.xxhash64("id", F.lit("fit")).alias("order"),
                                (F.length("x") / 4).cast("long").alias("features")))
    # At most ``train_rows`` pairs of numbers.
    total = 0
    for order, size in sorted(map(tuple, known_rows.select("order", "features").collect())):
        total += size
        if total > train_features:
            known_rows = known_rows.where(F.col("order") < order)
            break
    found = (known_rows.select("x", "y").repartition(1)
             .mapInPandas(learn, "weights binary, squares binary, slope double, intercept double")
             .first())
    if found is None:  # no labelled row at all
        return fit([], np.zeros(0)) | {"intercept": 0.0}
    return found.asDict() | {k: np.frombuffer(found[k], dtype="<f8")
                             for k in ("weights", "squares")}


def score_column(model: dict, body: Column) -> Column:
    """Probability (0 to 1) that a text's label is 1; an empty or null text has
    no feature and gets the intercept's."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grams = Ngrams()
        weights, squares = model["weights"], model["squares"]
        for part in texts:
            margins = np.zeros(len(part))
            for i, t in enumerate(part):
                x = grams.of(t)
                norm = squares[x].sum()
                margins[i] = weights[x].sum() / np.sqrt(norm) if norm > 0 else 0.0
            yield pd.Series(1 / (1 + np.exp(-(model["slope"] * margins + model["intercept"]))))

    return score(body)


def quality_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id",
                   text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) for every row.

    Only the text is an input of the score. Repeated rows keep their own row
    and score alike; a null id is not held out. Without labels every score is
    0.5. Empty input gives no rows; other columns are ignored.
    """
    model = train(docs, labels, doc_id=doc_id, text=text, label=label, train_rows=train_rows)
    key, body = quoted(docs, doc_id, text)
    return (docs.select(key.alias("doc_id"), held_out(key).alias("held_out"),
                        score_column(model, body).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id",
                 text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS,
                 threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns that score at least ``threshold``."""
    model = train(docs, labels, doc_id=doc_id, text=text, label=label, train_rows=train_rows)
    body, = quoted(docs, text)
    return (docs.select(F.struct("*").alias("row"), score_column(model, body).alias("score"))
            .where(F.col("score") >= threshold).select("row.*"))
