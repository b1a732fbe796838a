"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction reads one byte at a time and keeps a small state ``h``::

    z, c = split(squash(E[byte] + h U))      gate and candidate, squash(a) = a / (1 + |a|)
    h    = c + (z + 1) / 2 * (h - c)         the gate decides how much of the state stays

(a light gated unit: an update gate, no reset gate). Both states at a byte give that position's
language probabilities; a document's are the mean over all its positions. The network is trained in
numpy by backpropagation through time on windows of ``WINDOW`` bytes and applied to whole texts, many at a time. Long texts
are cut into chunks of ``CHUNK`` bytes that are read side by side. States do not start anew at a cut: the forward state
is run in over the ``LEAD`` bytes before the chunk, the backward state over those behind it. With the networks trained
on the test tables 256 bytes already give the probabilities of an unbroken run to the last bit of single precision.

A text that is null or has no letter is ``und`` with score 0. Repeated rows get equal results, equal shares go to the
language that sorts first. Without any labelled row every text is ``und``; with one language every other text is of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct, sample_texts

WINDOW = 64
HIDDEN = 8
#: Bound of the training sample: rows of each language, and the longest text that takes part.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_MAX_CHARS = 50_000
#: Bytes of a chunk, and bytes around it over which states are run in.
CHUNK, LEAD = 2048, 256
#: Bytes that are labelled at a time; bounds the memory of a worker.
GROUP = 1 << 19
#: Texts of a slice.
TEXTS = 1024
UNKNOWN = "und"


def windows(data: np.ndarray) -> np.ndarray:
    """All windows of a text's bytes, the last one padded with zero bytes."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode(), np.uint8)


@dataclass
class ByteTagger:
    """``table`` (2, 256, 2h) holds each direction's input weights by byte, ``inner`` (2, h, 2h) the recurrent ones."""

    languages: list[str]
    table: np.ndarray
    inner: np.ndarray
    outer: np.ndarray  # (2, h, languages)
    bias: np.ndarray

    def states(self, data: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Piece and place of every byte of the pieces (longest first), and its forward and backward states (byte, h)."""
        h, kind = self.inner.shape[1], self.table.dtype
        sizes = np.array([len(d) for d in data])
        steps = np.arange(sizes[0])
        counts = np.searchsorted(-sizes, -steps, "left")  # pieces that are longer than the step
        offsets = np.cumsum(counts) - counts
        place = np.repeat(steps.astype(np.int32), counts)
        piece = (np.arange(counts.sum()) - offsets[place]).astype(np.int32)
        whole, begins = np.concatenate(data), np.cumsum(sizes) - sizes
        back = (sizes[piece] - 1).astype(np.int32) - place
        codes = np.empty((2, len(piece)), np.int16)
        codes[0] = whole[begins[piece] + place]
        codes[1] = whole[begins[piece] + back]
        codes[1] += 256
        table, out = self.table.reshape(-1, 2 * h), np.empty((2, len(piece), h), kind)
        state, first, second = np.zeros((2, len(data), h), kind), np.empty((2, len(data), 2 * h), kind), np.empty((2, len(data), 2 * h), kind)
        for n, at in zip(counts.tolist(), offsets.tolist(), strict=True):
            if n < first.shape[1]:
                state, first, second = (np.ascontiguousarray(x[:, :n]) for x in (state, first, second))
            np.take(table, codes[:, at : at + n], axis=0, out=first, mode="clip")
            np.matmul(state, self.inner, out=second)
            first += second
            np.abs(first, out=second)
            second += 1
            first /= second
            z, c = first[..., :h], first[..., h:]
            z += 1
            z *= 0.5
            state -= c
            state *= z
            state += c
            out[:, at : at + n] = state
        # The backward state of a place was reached as many steps from the piece's end.
        return piece, place, out[0], out[1][offsets[back] + piece]

    def label(self, data: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, place and probabilities (language, byte) of every byte of the texts, group by group."""
        pieces = []  # length, text, first byte, first and last byte of the chunk proper
        for i, d in enumerate(data):
            for start in range(0, len(d), CHUNK):
                stop = min(len(d), start + CHUNK)
                low, high = max(0, start - LEAD), min(len(d), stop + LEAD)
                pieces.append((high - low, i, low, start, stop))
        pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
        while pieces:
            n = max(1, int(np.searchsorted(np.cumsum([x[0] for x in pieces]), GROUP, "right")))
            group, pieces = pieces[:n], pieces[n:]
            size, text, low, start, stop = (np.array(x) for x in zip(*group, strict=True))
            piece, place, forward, backward = self.states([data[i][a : a + n] for n, i, a, _, _ in group])
            text, place = text[piece], place + low[piece]
            if (low < start).any() or (low + size > stop).any():
                own = (place >= start[piece]) & (place < stop[piece])
                text, place, forward, backward = text[own], place[own], forward[own], backward[own]
            p = self.outer[0].T @ forward.T
            p += self.outer[1].T @ backward.T
            p += self.bias[:, None]
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            yield text, place, p

    def label_positions(self, text: str) -> list[str]:
        """The language of every byte of the lower-cased text."""
        data = as_bytes(text)
        if not len(data):
            return []
        best = np.zeros(len(data), int)
        for _, place, p in self.label([data]):
            best[place] = p.argmax(0)
        return [self.languages[i] for i in best]

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float], list[int], list[float]]:
        """For each text: language, pooled probability, number of positions, share of positions with that label."""
        out = ([UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts))
        k = len(self.languages)
        known = [(as_bytes(t), i) for i, t in enumerate(texts) if t and k and any(map(str.isalpha, t))]
        if not known:
            return out
        n = len(known)
        sums, votes = np.zeros((k, n)), np.zeros(n * k)
        for owner, _, p in self.label([d for d, _ in known]):
            for j in range(k):
                sums[j] += np.bincount(owner, p[j], n)
            votes += np.bincount(owner * k + p.argmax(0), minlength=n * k)
        shares, votes = sums.T / sums.sum(0)[:, None], votes.reshape(n, k)
        for row, (data, i) in enumerate(known):
            j = int(shares[row].argmax())
            out[0][i], out[1][i], out[2][i] = self.languages[j], float(min(1.0, shares[row, j])), len(data)
            out[3][i] = float(votes[row, j] / len(data))
        return out


def loss_and_gradients(m: ByteTagger, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of the windows ``x`` with languages ``y``, by backpropagation through time."""
    n, steps = x.shape
    h = m.inner.shape[1]
    both = np.stack([x.T, x.T[::-1]], axis=1).astype(np.intp)
    state = np.zeros((2, n, h), m.inner.dtype)
    olds, zs, cs, slopes, news = [], [], [], [], []
    for t in range(steps):
        a = np.stack([m.table[0][both[t, 0]], m.table[1][both[t, 1]]]) + state @ m.inner
        wide = 1 + np.abs(a)
        s = a / wide
        z, c = (s[..., :h] + 1) / 2, s[..., h:]
        olds.append(state)
        state = c + z * (state - c)
        zs.append(z), cs.append(c), slopes.append(1 / (wide * wide)), news.append(state)
    forward, backward = np.stack([s[0] for s in news]), np.stack([s[1] for s in news[::-1]])
    logits = forward @ m.outer[0] + backward @ m.outer[1] + m.bias
    logits -= logits.max(-1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(-1, keepdims=True)
    live = (x.T != 0).astype(p.dtype)
    count = max(1.0, live.sum())
    loss = -float((np.log(p[:, np.arange(n), y] + 1e-12) * live).sum() / count)
    p[:, np.arange(n), y] -= 1
    d = p * (live / count)[..., None]
    g = {"outer": np.stack([np.einsum("tnh,tnk->hk", s, d) for s in (forward, backward)]), "bias": d.sum((0, 1)), "inner": np.zeros_like(m.inner), "table": np.zeros_like(m.table)}
    into = np.stack([d @ m.outer[0].T, (d @ m.outer[1].T)[::-1]], axis=1)  # (t, 2, n, h)
    later = np.zeros_like(state)
    for t in range(steps - 1, -1, -1):
        e = into[t] + later
        gap = olds[t] - cs[t]
        da = np.concatenate([e * gap / 2, e * (1 - zs[t])], axis=-1) * slopes[t]
        g["inner"] += olds[t].transpose(0, 2, 1) @ da
        np.add.at(g["table"][0], both[t, 0], da[0])
        np.add.at(g["table"][1], both[t, 1], da[1])
        later = e * zs[t] + da @ m.inner.transpose(0, 2, 1)
    return loss, g


def train(samples: list[tuple[str, str]], steps: int = 220, batch: int = 128, rate: float = 0.02, seed: int = 1) -> ByteTagger:
    """Adam on random windows, as many of each language. The same samples give the same network."""
    samples = [(t, y) for t, y in samples if t and any(map(str.isalpha, t))]
    languages = sorted({y for _, y in samples})
    rng = np.random.default_rng(seed)
    k = max(1, len(languages))
    m = ByteTagger(languages, rng.normal(0, 0.5, (2, 256, 2 * HIDDEN)), rng.normal(0, 0.3, (2, HIDDEN, 2 * HIDDEN)), rng.normal(0, 0.3, (2, HIDDEN, k)), np.zeros(k))
    if len(languages) > 1:
        pools = [np.concatenate([windows(as_bytes(t)) for t, y in samples if y == lang]) for lang in languages]
        first, second = {}, {}
        for step in range(1, steps + 1):
            y = ((step - 1) * batch + np.arange(batch)) % k  # goes on where the last batch ended
            x = np.stack([pools[j][rng.integers(len(pools[j]))] for j in y])
            # A quarter of the windows are cut short, as short texts are.
            x *= np.arange(WINDOW) < np.where(rng.random(batch) < 0.25, rng.integers(4, WINDOW, batch), WINDOW)[:, None]
            _, grads = loss_and_gradients(m, x, y)
            for name, g in grads.items():
                first[name] = 0.9 * first.get(name, 0) + 0.1 * g
                second[name] = 0.99 * second.get(name, 0) + 0.01 * g * g
                value = getattr(m, name)
                value -= rate * min(1.0, 2 * (1 - step / (steps + 1))) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    for name in ("table", "inner", "outer", "bias"):
        setattr(m, name, getattr(m, name).astype(np.float32))
    return m


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteTagger:
    """Trains on a bounded sample of ``docs`` (see ``sample_texts``); the caller leaves out held-out rows."""
    return train(sample_texts(docs, docs, id_col, lang_col, text_col, SAMPLE_PER_LANGUAGE, SAMPLE_MAX_CHARS))


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("positions", T.LongType()), T.StructField("agreement", T.DoubleType())]


def identify(docs: DataFrame, model: ByteTagger, text_col: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct ``into``: language, pooled probability, positions read, share of positions with that label.

    A row for every row, other columns as they are; ``into`` must not be one of them (``ValueError``). Null texts and
    texts without a letter are ``und`` with score 0; an empty table gives an empty table.
    """

    def make():
        def handle(texts):
            lang, score, n, agree = model.documents(texts)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(agree, pa.float64())]

        return handle

    return append_struct(docs, text_col, FIELDS, into, make, TEXTS)
