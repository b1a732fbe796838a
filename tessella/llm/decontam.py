"""Benchmark decontamination: BM25 search of test items by every training passage, then verified overlap.

Items are indexed once: postings by term, in blocks with the largest impact of each block. Every
document is cut into overlapping passages (twice the longest item at each step, four times its length),
so an item lies whole in some passage. A passage is a query, and all items whose BM25 score reaches
the item's own threshold are retrieved by block-max WAND. The threshold is what any passage scores that
holds the share ``overlap`` of the item's shingles: its full score less the largest impacts that
so many missing shingles can take away. So retrieval loses no item that verification would accept.

Before WAND, a bound over each item's heaviest terms is summed for all passages of a batch of documents
at once; only passages that can still reach some threshold are queried.

An item is verified if at least ``overlap`` of its five-word shingles occur in the passage. Its question and
answer (given as columns, or the text before and after its last line or sentence break) get an overlap of their own.
With ``by_question`` an item also counts where at least ``overlap`` of its question's shingles occur, with or without
the answer (``answer_overlap`` tells). The question is then an entry of the index of its own, with a threshold of its
own, so that a short question does not lower the bar of its item. A question of less than one full shingle says
too little and leaves its item to be judged as a whole. The score that is reported is that of the whole item.
Items without words match nothing. Null and empty documents hold nothing. Items and documents may repeat; every
row of documents is reported with each item once.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, append_struct, fresh, stash, unstash

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 8
#: Share of an item's threshold that its light terms may reach; they are left out of the first bound.
LIGHT = 0.3
#: Items are searched in shards of at most so many characters each; a shard is sent to every worker.
SHARD_CHARS = 16_000_000
_BREAK = re.compile(r"\n|(?<=[.?!])\s")


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: what stands before and after the last line or sentence break."""
    breaks = [m for m in _BREAK.finditer(text.rstrip())]
    return (text[: breaks[-1].start()], text[breaks[-1].end() :]) if breaks else (text, "")


def grams(words: list) -> list[tuple]:
    n = min(SHINGLE, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []


def held_share(part: list[tuple], there: set) -> float:
    """Share of the shingles ``part`` that are among ``there``; 1 for an empty part."""
    return sum(g in there for g in part) / len(part) if part else 1.0


class ItemIndex:
    """``items``: (id, text, question, answer). Entries of the index are the items and, with ``by_question``, their questions."""

    def __init__(self, items: list[tuple[int, str, str, str]], overlap: float = OVERLAP, by_question: bool = False):
        split = [(i, WORD.findall((t or "").lower()), WORD.findall((q or "").lower()), WORD.findall((a or "").lower())) for i, t, q, a in items]
        self.items = [x for x in split if x[1]]
        self.overlap = overlap
        self.by_question = by_question
        n = len(self.items)
        entries = [(at, words) for at, (_, words, _, _) in enumerate(self.items)]
        if by_question:
            entries += [(at, question) for at, (_, words, question, _) in enumerate(self.items) if len(question) >= SHINGLE and question != words]
        self.owner = [at for at, _ in entries]
        self.longest = max((len(words) for _, words in entries), default=1)
        self.vocabulary: dict[str, int] = {}
        counts = [Counter(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words) for _, words in entries]
        df = Counter(t for c in counts[:n] for t in c)
        average = sum(len(words) for _, words in entries[:n]) / max(1, n)
        self.impacts: list[dict[int, float]] = []
        for (_, words), c in zip(entries, counts, strict=True):
            norm = K1 * (1 - B + B * len(words) / average)
            self.impacts.append({t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()})
        # Postings in the order of entries, with the largest impact of every block of them.
        self.postings: dict[int, tuple[list[int], list[float], list[float]]] = {}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for at, impact in enumerate(self.impacts):
            for t, v in impact.items():
                lists[t].append((at, v))
        for t, found in lists.items():
            values = [v for _, v in found]
            self.postings[t] = ([i for i, _ in found], values, [max(values[k : k + BLOCK]) for k in range(0, len(values), BLOCK)])
        self.threshold, need, heavy = [], [], defaultdict(list)
        for at, ((_, words), impact) in enumerate(zip(entries, self.impacts, strict=True)):
            ranked = sorted(impact.items(), key=lambda x: (-x[1], x[0]))
            least = self.least(ranked, words)
            self.threshold.append(least * (1 - 1e-9))
            light, keep = 0.0, list(ranked)
            while len(keep) > 1 and light + keep[-1][1] <= LIGHT * least:
                light += keep.pop()[1]
            need.append((least - light) * (1 - 1e-9))
            for t, v in keep:
                heavy[t].append((at, v))
        self.lowest = min(self.threshold, default=math.inf)
        # Heavy terms as one flat table: entries of term t are at starts[t]:starts[t + 1].
        self.starts = np.zeros(len(self.vocabulary) + 2, np.int64)
        for t, found in heavy.items():
            self.starts[t + 1] = len(found)
        self.starts = np.cumsum(self.starts)
        order = [heavy.get(t, []) for t in range(len(self.vocabulary) + 1)]
        self.heavy_entry = np.array([i for x in order for i, _ in x], np.int64)
        self.heavy_value = np.array([v for x in order for _, v in x])
        self.need = np.array(need)
        # Word numbers of text, question and answer; a word that no entry has is -1 and equals nothing.
        code = lambda words: grams([self.vocabulary.get(w, -1) for w in words])
        self.parts = [(code(words), code(question), code(answer)) for _, words, question, answer in self.items]

    def least(self, ranked: list[tuple[int, float]], words: list[str]) -> float:
        """The least score of a passage that holds the share ``overlap`` of the shingles of ``words``; ``ranked``: their impacts, largest first."""
        missing = int((1 - self.overlap) * max(1, len(words) - SHINGLE + 1) + 1e-9)
        return sum(v for _, v in ranked[missing:])

    def search(self, terms: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every entry (by position) whose score for the query reaches its threshold."""
        lists = [[0, *self.postings[t]] for t in terms if t in self.postings]  # cursor, items, impacts, block maxima
        highest = {id(x): max(x[3]) for x in lists}
        out = []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, None
            for k, x in enumerate(lists):
                bound += highest[id(x)]
                if bound >= self.lowest:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][1][lists[pivot][0]]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]] == item:
                pivot += 1
            before = lists[: pivot + 1]
            blocks = [(x, bisect_left(x[1], item, x[0])) for x in before]
            limit = sum(x[3][at // BLOCK] for x, at in blocks if at < len(x[1]))
            if limit >= self.threshold[item]:
                total = sum(x[2][at] for x, at in blocks if at < len(x[1]) and x[1][at] == item)
                if total >= self.threshold[item]:
                    out.append((item, total))
            for x, at in blocks:
                x[0] = at + (at < len(x[1]) and x[1][at] == item)
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text: (item id, score, overlap, question overlap, answer overlap) of every item that it holds."""
        step, size = 2 * self.longest, 4 * self.longest
        out: list[list[tuple]] = [[] for _ in texts]
        if not self.items:
            return out
        get = self.vocabulary.get
        coded, bases, hits_passage, hits_entry = [], [], [], []
        base = 0
        for t in texts:
            words = WORD.findall(t.lower()) if t else []
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words)) if words else np.zeros(0, np.int64)
            coded.append(ids)
            bases.append(base)
            at = np.flatnonzero(self.starts[ids + 1] > self.starts[ids])
            if len(at):
                # Each place lies in the passages that begin at its step and one step before.
                own = at // step
                passage = np.concatenate([own, own[own > 0] - 1])
                term = np.concatenate([ids[at], ids[at[own > 0]]])
                pair = np.unique(passage * (len(self.starts)) + term)
                hits_passage.append(base + pair // len(self.starts))
                hits_entry.append(pair % len(self.starts))
            base += len(ids) // step + 1
        if not hits_passage:
            return out
        passage, term = np.concatenate(hits_passage), np.concatenate(hits_entry)
        many = self.starts[term + 1] - self.starts[term]
        entry = np.repeat(self.starts[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat(passage, many) * len(self.owner) + self.heavy_entry[entry]
        cells, inverse = np.unique(cell, return_inverse=True)
        reach = np.bincount(inverse, self.heavy_value[entry])
        hopeful = np.unique(cells[reach >= self.need[cells % len(self.owner)]] // len(self.owner))
        best: list[dict[int, tuple]] = [{} for _ in texts]
        owner = np.searchsorted(bases, hopeful, side="right") - 1
        for p, d in zip(hopeful, owner, strict=True):
            start = int(p - bases[d]) * step
            words = coded[d][start : start + size].tolist()
            terms = set(words) - {0}
            found = sorted({self.owner[e] for e, _ in self.search(terms)})
            there = set(grams(words)) if found else set()
            for item in found:
                shares = tuple(self.share(part, words, there) for part in self.parts[item])
                asked = self.by_question and len(self.items[item][2]) >= SHINGLE and shares[1] >= self.overlap - 1e-12
                if (asked or shares[0] >= self.overlap - 1e-12) and (item not in best[d] or shares > best[d][item][2:]):
                    score = sum(v for t, v in sorted(self.impacts[item].items()) if t in terms)
                    best[d][item] = (self.items[item][0], score, *shares)
        for d, found in enumerate(best):
            out[d] = [found[item] for item in sorted(found)]
        return out

    @staticmethod
    def share(part: list[tuple], words: list[int], there: set) -> float:
        n = len(part[0]) if part else SHINGLE
        if n < SHINGLE:  # a part shorter than a shingle is looked up as it is
            there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        return held_share(part, there)


LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("overlap", T.DoubleType()), T.StructField("question_overlap", T.DoubleType()), T.StructField("answer_overlap", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def shard(items: DataFrame, k: int, count: int, item_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> list[tuple]:
    """The ``k``-th of ``count`` groups of items, without repeats."""
    none = F.lit(None).cast("string")
    mine = F.pmod(F.xxhash64(F.col(item_col).cast("string"), text_col), F.lit(count)) == k
    rows = items.where(mine).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"), (F.col(question_col) if question_col else none).alias("q"), (F.col(answer_col) if answer_col else none).alias("a")).distinct().collect()
    return [(r["i"], r["t"], *((r["q"], r["a"]) if question_col else split_item(r["t"] or ""))) for r in sorted(rows, key=lambda r: (r["i"] is None, r["i"], r["t"] or "", r["q"] or "", r["a"] or ""))]


_BUILT: dict[str, ItemIndex] = {}


def built(token: str, items: list[tuple], overlap: float, by_question: bool) -> ItemIndex:
    """The index of a shard, built once in a worker's life; a worker keeps one."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = ItemIndex(items, overlap, by_question)
    return _BUILT[token]


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", into: str = "leaks", item_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None, overlap: float = OVERLAP, shard_chars: int = SHARD_CHARS, by_question: bool = False) -> DataFrame:
    """Adds the array ``into`` with every item that the document holds, in the order of items; narrow, no shuffle.

    Other columns stay as they are; ``into`` must not be one of them (``ValueError``). Null and empty texts
    get an empty array, and so does every row where there are no items. Of several passages that hold an item the one
    with the largest overlaps is reported, the first on ties. Items of more than ``shard_chars`` characters are searched shard by
    shard; the rows are then written to the shared folder between shards, so that driver and workers hold one shard at a time.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into} exists already; use fresh()")
    total = items.agg(F.sum(F.length(item_text_col)).alias("n")).first()["n"] or 0
    count = -(-total // shard_chars) or 1

    def make(part: list[tuple], token: str):
        def build():
            index = built(token, part, overlap, by_question)

            def handle(texts):
                return [pa.array([[dict(zip(("item_id", "score", "overlap", "question_overlap", "answer_overlap"), x, strict=True)) for x in found] for found in index.leaks(texts)], _ARROW)]

            return handle

        return build

    out, names = docs, []
    for k in range(count):
        names.append(fresh(out, f"{into}_{k}"))
        before = out
        out = append_struct(out, text_col, [T.StructField("found", LEAK)], names[-1], make(shard(items, k, count, item_col, item_text_col, question_col, answer_col), uuid.uuid4().hex))
        if count > 1:
            out = stash(out, "shard")
            if k:
                unstash(before)
    return out.withColumn(into, F.concat(*[F.col(f"{n}.found") for n in names])).drop(*names)
