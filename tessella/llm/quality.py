"""Quality classifier: supervised subword embeddings.

Every blank-separated token has a vector for itself and one for each of its character n-grams
(with ``<`` and ``>`` at its ends), all in a hashed table. A document is the mean of all its
features' vectors; a softmax layer gives the label. Table and layer are learned together by
stochastic gradient descent in numpy. A token that repeats the one before it counts as the token
``REPEAT``, so that runs of a word are seen whatever the word is.

Scoring needs one number per feature (its vector times the layer). The n-grams of a whole text are hashed together
in arrays, without a memo of tokens, so the cost depends on the length of a text and not on how often its tokens recur.
Null and empty texts have no features and get the layer's bias alone. Without labelled rows of
both labels the score is the share of label 1 (0.5 if there are none).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_struct, sample_texts

BUCKETS = 1 << 17
DIMENSIONS = 8
SHORTEST, LONGEST = 3, 5
REPEAT = "\x00same"
#: Bound of the training sample: rows of each label, and the longest text that takes part.
SAMPLE_PER_LABEL = 900
SAMPLE_MAX_CHARS = 60_000
#: N-grams are hashed for so many places of a text at a time, by an odd multiplier; buckets are the upper bits.
PIECE = 1 << 16
MULTIPLIER = np.uint32(0x9E3779B1)
SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())


def grams(spaced: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of blank-separated tokens, from code points with a blank at both ends; blanks are the ends of tokens.

    A text is read in pieces, so memory does not grow with its length. An n-gram with a blank within it belongs to no token.
    """
    for at in range(0, len(spaced), PIECE):
        code = spaced[at : at + PIECE + LONGEST - 1]
        solid = code != 32
        hashed, valid = code, np.ones(len(code), bool)
        for n in range(2, LONGEST + 1):
            starts = min(PIECE, len(code) - n + 1)
            if starts <= 0:
                break
            hashed = hashed[:starts] * MULTIPLIER + code[n - 1 : n - 1 + starts]
            valid = valid[:starts] & solid[n - 2 : n - 2 + starts] if n > 2 else valid[:starts]
            if n >= SHORTEST:
                mixed = (hashed ^ (hashed >> 15)) * MULTIPLIER
                yield mixed[valid] >> SHIFT


def features(token: str) -> list[int]:
    """Buckets of a token and its character n-grams."""
    return [int(b) for part in buckets([token]) for b in part]


def buckets(found: list[str]) -> Iterator[np.ndarray]:
    """Buckets of all features of a text's tokens, in pieces."""
    plain = [t for t in found if t != REPEAT]
    if len(plain) < len(found):
        yield np.full(len(found) - len(plain), crc32(REPEAT.encode()) % BUCKETS)
    if plain:
        joined = " ".join(plain)
        words = joined.encode("utf-8", "replace").split(b" ")
        yield np.fromiter(map(crc32, words), np.uint32, len(words)) % BUCKETS
        yield from grams(np.frombuffer(f" {joined} ".encode("utf-32-le", "replace"), np.uint32))


def tokens(text: str) -> list[str]:
    found = text.split()
    if any(map(eq, found, islice(found, 1, None))):
        return found[:1] + [REPEAT if a == b else b for a, b in zip(found, islice(found, 1, None), strict=False)]
    return found


@dataclass
class QualityModel:
    weights: np.ndarray  # per bucket: vector times (column of label 1 minus column of label 0)
    bias: float

    def scorer(self):
        weights = self.weights

        def score(text: str | None) -> float:
            total, n = 0.0, 0
            for part in buckets(tokens(text or "")):
                total += float(weights[part].sum())
                n += len(part)
            mean = total / n if n else 0.0
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, mean + self.bias))))

        return score


def train(samples: Iterable[tuple[str, int]], share: float, epochs: int = 8, rate: float = 2.0, seed: int = 5) -> QualityModel:
    """``share`` is the share of label 1 among all labelled rows; the sample may hold another."""
    prior = math.log(min(max(share, 0.01), 0.99) / (1 - min(max(share, 0.01), 0.99)))
    learned = network(samples, epochs, rate, seed)
    if learned is None:
        return QualityModel(np.zeros(BUCKETS), prior)
    table, layer, bias = learned
    return QualityModel(table @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0] + prior))


def network(samples: Iterable[tuple[str, int]], epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Vectors of all buckets, softmax layer and bias; None without samples of both labels."""
    docs, labels = [], []
    for text, label in samples:
        counts = sum((np.bincount(part, minlength=BUCKETS) for part in buckets(tokens(text or ""))), np.zeros(BUCKETS, np.int64))
        ids = np.flatnonzero(counts)
        if len(ids):
            docs.append((ids, (counts[ids] / counts.sum()).astype(np.float32)))
            labels.append(int(label))
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    table, layer, bias = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    balance = len(y) / (2 * np.bincount(y, minlength=2))
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, w = docs[i]
            hidden = w @ table[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= balance[y[i]] * rate * (1 - step / steps)
            table[ids] -= np.outer(w, layer @ p)
            layer -= np.outer(hidden, p) * 0.1
            bias -= p * 0.1
            step += 1
    return table, layer, bias


def share_of_ones(labelled: DataFrame, label_col: str) -> float:
    row = labelled.where(F.col(label_col).isNotNull()).agg(F.avg(F.col(label_col).cast("double")).alias("p")).first()
    return 0.5 if row["p"] is None else row["p"]


def fit(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> QualityModel:
    """Trains on a bounded sample; the caller leaves held-out rows out of ``labelled``."""
    return train(sample_texts(labelled, docs, id_col, label_col, text_col, SAMPLE_PER_LABEL, SAMPLE_MAX_CHARS), share_of_ones(labelled, label_col))


def score(docs: DataFrame, model, text_col: str = "text", into: str = "result") -> DataFrame:
    """Adds the struct ``into`` with ``score``, the probability of label 1."""

    def make():
        one = model.scorer()
        return lambda texts: [pa.array([one(t) for t in texts], pa.float64())]

    return append_struct(docs, text_col, [T.StructField("score", T.DoubleType())], into, make)
