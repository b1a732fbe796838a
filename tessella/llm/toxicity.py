"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram within a word of the lower-cased text (``<`` and
``>`` mark the word's ends). Its value is its log ratio of smoothed document frequencies in the two
classes; logistic weights on these values are learned from labelled text. An n-gram is a feature if its
document frequencies in the classes differ by ``SIGNIFICANT`` standard errors, or by ``ONE_SIDED`` if only one
class has it at all, as rare offensive words have; there is no other limit on their number.

Presence is taken over the whole text, so one offending word counts as much in a long text as in a
short one. Null and empty texts have no features and get the bias alone. Rows with equal texts get equal scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .bpe import Memo
from .common import sample_texts
from .quality import share_of_ones
from .quality import score as score  # the same Spark operator applies both models

SHORTEST, LONGEST = 3, 6
WORD = re.compile(r"[^\W\d_]+")
#: Bound of the training sample: rows of each label, and the longest text that takes part.
SAMPLE_PER_LABEL = 1200
SAMPLE_MAX_CHARS = 60_000
#: Words longer than this are not kept in a worker's memo.
MEMO_TOKEN = 64
#: Standard errors by which an n-gram's document frequencies must differ, and by which those of one that only one label has.
SIGNIFICANT, ONE_SIDED = 4.5, 3.0
#: N-grams of sampled texts that are counted at a time; bounds the memory of training.
CHUNK = 1_000_000


def grams(word: str) -> Iterator[int]:
    """Hashes of the character n-grams of a word."""
    w = f"<{word}>"
    for n in range(SHORTEST, LONGEST + 1):
        for i in range(len(w) - n + 1):
            yield crc32(w[i : i + n].encode("utf-8", "replace"))


def words_of(text: str | None) -> set[str]:
    """The different words of a text."""
    return set(WORD.findall(text.lower())) if text else set()


def documents(samples: list[tuple[str, int]], memo: Memo) -> Iterator[np.ndarray]:
    """The sorted n-grams of each text; ``memo`` has those of a word."""
    for text, _ in samples:
        found = [memo[w] for w in words_of(text)]
        yield np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def frequencies(samples: list[tuple[str, int]], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the sample, sorted, and the number of texts of each label (2, n-grams) that have them."""
    keys, counts, held, size = np.zeros(0, np.uint32), np.zeros((2, 0), np.int32), ([], []), 0

    def merge():
        nonlocal keys, counts, size
        for label in (0, 1):
            if held[label]:
                new, more = np.unique(np.concatenate(held[label]), return_counts=True)
                held[label].clear()
                both = np.union1d(keys, new)
                grown = np.zeros((2, len(both)), np.int32)
                grown[:, np.searchsorted(both, keys)] = counts
                grown[label, np.searchsorted(both, new)] += more.astype(np.int32)
                keys, counts = both, grown
        size = 0

    for (_, label), found in zip(samples, documents(samples, memo), strict=True):
        held[int(label)].append(found)
        size += len(found)
        if size > CHUNK:
            merge()
    merge()
    return keys, counts


@dataclass
class ToxicityModel:
    weights: dict[int, float]  # n-gram hash: log-count ratio times learned weight
    bias: float

    def scorer(self):
        weights = self.weights
        memo = Memo(lambda w: tuple({g for g in grams(w) if g in weights}), 100_000, MEMO_TOKEN)

        def score(text: str | None) -> float:
            present: set[int] = set()
            for hit in filter(None, map(memo.__getitem__, words_of(text))):
                present.update(hit)
            z = self.bias + math.fsum(weights[g] for g in present)
            return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

        return score


def train(samples: Iterable[tuple[str, int]], share: float, epochs: int = 12, rate: float = 0.3, penalty: float = 1e-4, seed: int = 5, significant: float = SIGNIFICANT) -> ToxicityModel:
    """``share`` is the share of label 1 among all labelled rows; the sample may hold another.

    The sample is read twice, to count document frequencies and to note each document's kept n-grams, so what
    is held beside the texts is a pair of counts per n-gram and the kept n-grams of each document.
    """
    samples = list(samples)
    y = np.array([int(label) for _, label in samples])
    limit = min(max(share, 0.01), 0.99)
    prior = math.log(limit / (1 - limit))
    n = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
    if min(n) == 0:
        return ToxicityModel({}, prior)
    memo = Memo(lambda w: np.fromiter(grams(w), np.uint32), 100_000, MEMO_TOKEN)
    keys, counts = frequencies(samples, memo)
    rates = [(c + 1) / (m + 2) for c, m in zip(counts, n, strict=True)]
    ratio = np.log(rates[1] / rates[0])
    pooled = (counts[0] + counts[1] + 1) / (n.sum() + 2)
    z = np.abs(rates[1] - rates[0]) / np.sqrt(pooled * (1 - pooled) * (1 / n[0] + 1 / n[1]))
    kept = np.flatnonzero((z >= significant) | (z >= ONE_SIDED) & (counts.min(axis=0) == 0))
    r, keys = ratio[kept], keys[kept]
    del counts, rates, ratio, pooled, z
    rows = []
    for found in documents(samples, memo):
        at = np.searchsorted(keys, found)
        at[at == len(keys)] = 0
        rows.append(at[keys[at] == found].astype(np.int32) if len(keys) else at)
    w, b = np.zeros(len(kept)), 0.0
    rng = np.random.default_rng(seed)
    squares, bias_square = np.full(len(kept), 1e-6), 1e-6
    balance = len(y) / (2 * n)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, b + float(w[at] @ r[at])))))
            e = (p - y[i]) * balance[y[i]]
            g = e * r[at] + penalty * w[at]
            squares[at] += g * g
            w[at] -= rate * g / np.sqrt(squares[at])
            bias_square += e * e
            b -= rate * e / math.sqrt(bias_square)
    return ToxicityModel({int(k): float(v) for k, v in zip(keys, r * w, strict=True) if v}, b + prior)


def fit(labelled: DataFrame, docs: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> ToxicityModel:
    """Trains on a bounded sample; the caller leaves held-out rows out of ``labelled``."""
    return train(sample_texts(labelled, docs, id_col, label_col, text_col, SAMPLE_PER_LABEL, SAMPLE_MAX_CHARS), share_of_ones(labelled, label_col))
