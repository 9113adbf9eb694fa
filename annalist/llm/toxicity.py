"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its different words and their stems, pairs of neighbouring words, and pairs with one or two words
between, hashed.
Labelled texts are read one after another; each coordinate keeps its own sum of squared gradients, and so its own
learning rate, and a proximal sum whose L1 threshold leaves most weights at exactly zero. What is left is a short list of
weights, broadcast to score every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import crc_remainder, drop_settled, fold_arrow, map_batches, settle, table

#: Buckets of the hash; the last one is the bias.
FEATURES = 1 << 22
BIAS = FEATURES
#: Pairs of words are taken with up to this many words between them.
SKIPS = 2
#: A word's stems are its first letters, so many, if it has more: what is inflected or compounded is met again.
STEMS = (4, 5, 6, 7)
#: Labelled ids that are learned from at most, those of the smallest hashes, and how often each is read.
SAMPLE, PASSES = 20_000, 8
#: A worker forgets its words between texts once it knows so many.
REMEMBERED = 600_000
#: Rate and its offset, L1 and L2 of the proximal step.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.01
_MARKS = ".,;:!?\"'()[]{}#*$%&|<>=+-_~^/\\@"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


_STEP, _LONG = int(_STEPS[0]), (1 << 64) - 1


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes * _STEPS[0] >> np.uint64(64 - 22)).astype(np.int32)


class _Words(dict):
    """What a worker remembers of words: the hash of each without marks around it and, in stems, the buckets of its stems, only weighed ones if some are."""

    def __init__(self, weighed: np.ndarray | None = None):
        self.stems: dict[bytes, tuple[int, ...]] = {}
        self.weighed = None if weighed is None else frozenset(weighed.tolist())

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "surrogatepass")
        text = text.strip(_MARKS) or text
        found = [(_hash(f"{text[:n]}\x00{n}") * _STEP & _LONG) >> 42 for n in STEMS if len(text) > n]  # as _bucket() does
        self.stems[word] = tuple(found if self.weighed is None else self.weighed.intersection(found))
        self[word] = out = _hash(text)
        return out


def buckets(text: str | None, known: _Words) -> np.ndarray:
    """The buckets of a text's words, stems, pairs and skipping pairs, in any order and with repeats."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if len(known) > REMEMBERED:
        known.clear()
        known.stems.clear()
    h = np.array(list(map(known.__getitem__, words)), dtype=np.uint64)
    stems = set(chain.from_iterable(map(known.stems.__getitem__, set(words))))
    parts = [_bucket(h), np.array(list(stems), dtype=np.int32)]
    for gap in range(1, SKIPS + 2):
        if len(h) > gap:
            parts.append(_bucket(h[:-gap] * _STEPS[gap] ^ (h[gap:] + np.uint64(gap))))
    return np.concatenate(parts)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic (0 or 1) of docs (doc_id, text) whose id has a label; null labels count as 0, the worse of several holds.

    Of more than SAMPLE labelled ids those of the smallest hashes are broadcast; only their texts are read.
    """
    of = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.max(F.coalesce("toxic", F.lit(0))) > 0).cast("int").alias("toxic"))
    chosen = of.orderBy(F.xxhash64("l_id", F.lit("toxic")), "l_id").limit(SAMPLE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id")).select("doc_id", "text", "toxic")


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression on presence features."""

    def __init__(self, features: int):
        self.z, self.n = np.zeros(features + 1), np.zeros(features + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        pulled = np.sign(z) * np.maximum(np.abs(z) - np.where(at == len(self.z) - 1, 0.0, L1), 0.0)
        return -pulled / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, y: int) -> float:
        """One step on a row's different features; the probability before it."""
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = p - y
        had = self.n[at]
        self.z[at] += g - (np.sqrt(had + g * g) - np.sqrt(had)) / ALPHA * w
        self.n[at] = had + g * g
        return p


def learn(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features with a weight and their weights, from rows (doc_id, text, toxic) of at most about SAMPLE ids.

    Features are made wherever the rows lie; then one task reads them in the order of a hash, as each step depends on the
    one before. It holds the features of SAMPLE texts and two sums for each bucket, and returns the weights that aren't zero.
    """

    def found(parts: Iterator[dict]) -> Iterator[dict]:
        known = _Words()
        for part in parts:
            yield {"doc_id": part["doc_id"], "toxic": part["toxic"], "at": [np.unique(buckets(t, known)) for t in part["text"]]}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        data = []
        for batch in batches:  # numbers stay in arrays: a text's features are four bytes each
            flat, ends = np.asarray(batch.column(1).flatten()), np.cumsum(np.asarray(batch.column(1).value_lengths()))
            data += [(np.append(at, np.int32(BIAS)), y) for at, y in zip(np.split(flat, ends[:-1]), batch.column(0).to_pylist(), strict=True)]
        model = Ftrl(FEATURES)
        for _ in range(PASSES):
            for at, y in data:
                model.learn(at, y)
        w = model.weights(np.arange(FEATURES + 1))
        at = np.flatnonzero(w)
        yield {"at": at.astype(np.int32), "weight": w[at]}

    features = settle(fold_arrow(rows, found, "doc_id long, toxic int, at array<int>"), "toxic-features")
    order = features.coalesce(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id", "toxic", F.hash("at"))
    weights = map_batches(order.select("toxic", "at"), fit, "at int, weight double").orderBy("at").toArrow()
    drop_settled(features)
    return np.asarray(weights.column("at").combine_chunks()), np.asarray(weights.column("weight").combine_chunks())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score and predicted for every row of docs (doc_id, text).

    Null and empty texts, and texts without a weighed feature, take the bias's score. Without a label to learn from all
    scores are 0. Repeated rows are scored alike; an empty table gives no rows. Whole texts count, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[dict]) -> Iterator[dict]:
        at, weight = shared.value
        dense = np.zeros(FEATURES + 1, dtype=np.float32)
        dense[at] = weight
        bias, known = float(dense[BIAS]), _Words(at)
        place, weight = np.asarray(at), np.asarray(weight)
        for part in parts:
            scores = []
            for text in part["text"]:
                hit = buckets(text, known)
                hit = np.unique(hit[dense[hit] != 0])
                total = bias + weight[np.searchsorted(place, hit)].sum() if len(at) else -np.inf
                scores.append(float(1 / (1 + np.exp(-np.clip(total, -700, 700)))) if len(at) else 0.0)
            yield {"doc_id": part["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fold_arrow(rows, run, "doc_id long, score double, predicted int")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    model = learn(labelled(docs.where(~held_out), table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
