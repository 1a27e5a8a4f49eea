"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, their character n-grams and one mark for a word that
repeats its predecessor (the one word pair that is told apart); a softmax of it gives the classes. Features of the
labelled rows are counted on the executors, so the driver gets numbers instead of texts; training is plain stochastic
gradient descent in numpy, on the driver, over a bounded and documented sample of labelled rows (TRAIN). Since the output
is linear in the average, every feature is worth one number at scoring time: a word is looked up once and remembered,
and a document costs one dictionary access a word.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_row, table

#: Labelled rows that training takes at most (the first by hash of the id; a row has BUCKETS features at most, 8 bytes
#: each), hash buckets, vector size, passes, step.
TRAIN, BUCKETS, DIM, EPOCHS, RATE, SEED = 1500, 1 << 17, 12, 8, 0.35, 11
GRAMS, FOLDS, THRESHOLD, CACHE = (3, 4), 5, 0.3, 150_000
REPEAT = "\0="


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its character n-grams between word marks."""
    marked = f"<{word}>".encode()
    return [zlib.crc32(marked) % BUCKETS] + [zlib.crc32(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]


def tokens(text: str | None) -> list[str]:
    """Lower-cased words, with a mark after each word that repeats the one before."""
    words = (text or "").lower().split()
    return words + [REPEAT] * sum(map(str.__eq__, words, words[1:]))


def _counts(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    parts = []
    for w in tokens(text):
        if (f := known.get(w)) is None:
            f = known[w] = np.array(word_features(w), np.int32)
        parts.append(f)
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    ids, n = np.unique(np.concatenate(parts), return_counts=True)
    return ids.astype(np.int32), (n / n.sum()).astype(np.float32)


def train(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, float]:
    known: dict[str, np.ndarray] = {}
    return descend([_counts(t, known) for t in texts], labels)


def descend(each: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> tuple[np.ndarray, float]:
    """(worth of each feature, bias): the log odds of label 1 are the mean worth plus the bias.

    From features and their shares, row by row. The rarer class weighs more, up to 3 times. Without rows of both classes
    the score is the share of label 1.
    """
    y = np.array(labels, np.int64)
    share = float((y.sum() + 1) / (len(y) + 2))
    prior = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), prior
    # Features of all rows stand in two flat arrays: a driver has little memory, and these go back whole.
    ends = np.cumsum([0, *(len(ids) for ids, _ in each)])
    flat_ids, flat_parts = np.concatenate([ids for ids, _ in each]), np.concatenate([part for _, part in each])
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.array([0, prior], np.float32)
    rare = np.minimum(3.0, len(y) / 2 / np.maximum(np.bincount(y, minlength=2), 1))
    steps = EPOCHS * len(y)
    for step, i in enumerate(np.concatenate([rng.permutation(len(y)) for _ in range(EPOCHS)])):
        ids, part = flat_ids[ends[i] : ends[i + 1]], flat_parts[ends[i] : ends[i + 1]]
        hidden = part @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
        z = out @ hidden + bias
        p = np.exp(z - z.max())
        error = p / p.sum()
        error[y[i]] -= 1
        error *= RATE * (1 - step / steps) * rare[y[i]]
        back = error @ out
        out -= np.outer(error, hidden)
        bias -= error
        if len(ids):
            # A feature's step is scaled by the number of features, as if each moved in a sample of its own.
            vectors[ids] -= (part * len(ids) ** 0.5)[:, None] * back
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


class Worth(dict):
    """Word to the sum of its features' worth; `sizes` has their number. Both forget when full."""

    def __init__(self, worth: np.ndarray) -> None:
        super().__init__()
        self.worth, self.sizes = worth, {}

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
            self.sizes.clear()
        f = word_features(word)
        self[word] = s = float(self.worth[f].sum())
        self.sizes[word] = len(f)
        return s

    def score(self, text: str | None, bias: float) -> float:
        words = tokens(text)
        if not words:
            return float(1 / (1 + np.exp(-bias)))
        if len(words) > CACHE // 2:
            pairs = [(self[w], self.sizes[w]) for w in words]
            total, n = sum(a for a, _ in pairs), sum(b for _, b in pairs)
        else:
            if len(self) + len(words) > CACHE:
                self.clear()
                self.sizes.clear()
            total = sum(map(self.__getitem__, words))
            n = sum(map(self.sizes.__getitem__, words))
        return float(1 / (1 + np.exp(-np.clip(total / n + bias, -50, 50))))


def fold(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = TRAIN) -> tuple[np.ndarray, float]:
    """A model from labelled rows outside the held-out fold: the first `limit` labels by hash of the id.

    Null labels do not count; a null text has no features. Rows or labels that repeat an id each count. Without any row
    of both classes (or any at all) the model knows the share of label 1 only.
    """
    chosen = labels.filter((fold(id_col) != 0) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "y").limit(limit)
    rows = df.select(F.col(id_col).alias("id2"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id2") == F.col("id"))

    def make():
        known: dict[str, np.ndarray] = {}

        def work(texts: list) -> list:
            counts = [_counts(t, known) for t in texts]
            return [[ids.tobytes() for ids, _ in counts], [part.tobytes() for _, part in counts]]

        return work

    got = per_row(rows, ["id", "y"], "text", {"features": "binary", "shares": "binary"}, make).toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["y"], r["features"], r["shares"]))
    return descend([(np.frombuffer(r["features"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in got], [r["y"] for r in got])


def score_quality(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (of label 1, 0 to 1) and predicted (1 if score >= threshold). Null texts count as empty; an empty
    text gets the score of the bias alone. Every row is scored by its whole text; nothing else enters the score. Repeated
    rows stay, columns of df named score or predicted are replaced, all others pass through; an empty df gives no rows."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        worth, bias = sent.value
        cache = Worth(worth)

        def work(texts: list) -> list[list]:
            scores = [cache.score(t, bias) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return work

    return per_row(df, [c for c in df.columns if c.lower() not in ("score", "predicted")], text_col, {"score": "double", "predicted": "int"}, make)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")


SQL: dict[str, str] = {}
QUERIES = {"op10_quality": op10_quality}
