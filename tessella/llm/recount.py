"""Edit-aware token counts: a segment tree over each document's pre-tokens.

Leaves are runs of pre-tokens with their token counts; inner nodes hold sums of characters and tokens. An edit
is located by descending on character sums. Re-tokenising begins at a pre-token far enough before the edit
that nothing before it can change (``context`` characters: the longest look-ahead of the pattern or a special
token) and ends at the first place behind the edit where an old pre-token begins as well: the pattern
looks ahead only, so everything after that place is as before. Only new pre-tokens are encoded, and only
sums on the paths above touched leaves are renewed.

Trees are kept: ``index`` adds each document's tree as the characters and tokens of its pre-tokens, and ``recount`` takes it up
without cutting or encoding the text again; pre-tokens of a leaf are cut out only when an edit touches it. Its result has
the new tree for the next edits. A tree that does not belong to its text stops the job.

Null texts count as empty. An edit is (start, end, replacement) in characters of the text as it is by then; bounds
outside of the text are moved to its ends, a null replacement is empty, a null edit does nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO_PIECE, BytePairCodec, Memo, codec
from .common import append_struct, map_slices

LEAF = 64


class PieceCounter:
    """Cuts text into pre-tokens (special tokens stand alone) and counts the tokens of each."""

    def __init__(self, c: BytePairCodec):
        self.codec = c
        self.context = max(2, max(map(len, c.specials), default=0))
        self.memo = Memo(lambda piece: 1 if piece in c.specials else len(c.encode_word(piece.encode())), 300_000, MEMO_PIECE)

    def cut(self, text: str) -> list[str]:
        c = self.codec
        if c.special is None or not c.special.search(text):
            return c.pre_token.findall(text)
        out, at = [], 0
        for m in c.special.finditer(text):
            out += [*c.pre_token.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + c.pre_token.findall(text[at:])

    def counts(self, pieces: list[str]) -> list[int]:
        return list(map(self.memo.__getitem__, pieces))


class Span(NamedTuple):
    """A leaf that has not been touched: its text and the characters of its pre-tokens."""

    text: str
    sizes: np.ndarray


class CountTree:
    def __init__(self, text: str | None, counter: PieceCounter):
        self.counter, self.encoded_chars = counter, 0
        pieces = counter.cut(text or "")
        self._build([(pieces[i : i + LEAF], counter.counts(pieces[i : i + LEAF])) for i in range(0, len(pieces), LEAF)])

    @classmethod
    def kept(cls, text: str | None, sizes: np.ndarray, tokens: np.ndarray, counter: PieceCounter) -> CountTree:
        """The tree whose pre-tokens have so many characters and tokens."""
        text = text or ""
        ends = np.cumsum(sizes)
        if len(sizes) != len(tokens) or (int(ends[-1]) if len(ends) else 0) != len(text):
            raise ValueError("the tree belongs to another text")
        tree = cls.__new__(cls)
        tree.counter, tree.encoded_chars = counter, 0
        bounds = [0, *ends[LEAF - 1 :: LEAF].tolist()]
        if len(sizes) % LEAF:
            bounds.append(len(text))
        tree._build([(Span(text[a:b], sizes[i * LEAF : (i + 1) * LEAF]), tokens[i * LEAF : (i + 1) * LEAF]) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])
        return tree

    def _build(self, leaves: list[tuple[list[str] | Span, list[int] | np.ndarray]]) -> None:
        self.pieces = [p for p, _ in leaves] or [[]]
        self.counts = [n for _, n in leaves] or [[]]
        self.size = 1 << max(0, len(self.pieces) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (p, n) in enumerate(zip(self.pieces, self.counts, strict=True)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(p.text) if isinstance(p, Span) else len("".join(p)), int(sum(n))
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def row(self, leaf: int) -> list[str]:
        """The pre-tokens of a leaf."""
        p = self.pieces[leaf]
        if isinstance(p, Span):
            ends = np.cumsum(p.sizes).tolist()
            self.pieces[leaf] = p = [p.text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            self.counts[leaf] = self.counts[leaf].tolist()
        return p

    def state(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens."""
        sizes = [p.sizes if isinstance(p, Span) else np.fromiter(map(len, p), np.int32, len(p)) for p in self.pieces]
        return np.concatenate(sizes).astype(np.int32), np.concatenate([np.asarray(n, np.int32) for n in self.counts])

    def _pull(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(p.text if isinstance(p, Span) else "".join(p) for p in self.pieces)

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, piece within it and start of the piece that holds character ``at`` (the last piece for the end)."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        leaf = i - self.size
        row = self.row(leaf)
        for k, p in enumerate(row):
            if at < start + len(p) or k == len(row) - 1:
                return leaf, k, start
            start += len(p)
        return leaf, 0, start

    def count(self, start: int, end: int) -> int:
        """Tokens of the pre-tokens that begin at ``start`` or later and before ``end``."""
        return self._before(end) - self._before(start)

    def _before(self, at: int) -> int:
        if at <= 0:
            return 0
        if at >= self.length:
            return self.total
        leaf, k, start = self.find(at)
        i, total = leaf + self.size, sum(self.counts[leaf][: k + (start < at)])
        while i > 1:
            if i % 2:
                total += self.tokens[i - 1]
            i //= 2
        return total

    def _from(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        for i in range(leaf, len(self.pieces)):
            row = self.row(i)
            for j in range(k if i == leaf else 0, len(row)):
                yield i, j, row[j]

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, skip, origin = self.find(max(0, start - self.counter.context))
        if not self.length:
            first, skip, origin = 0, 0, 0
        shift = len(replacement) - (end - start)
        want = self.counter.context + 1
        while True:
            # Old pieces from the first one that may change up to a margin behind the edit.
            old: list[str] = []
            begins: dict[int, tuple[int, int]] = {}
            at, whole = origin, True
            for i, j, p in self._from(first, skip):
                if at >= end:
                    begins[at] = (i, j)
                    if at >= end + want:
                        whole = False
                        break
                old.append(p)
                at += len(p)
            before = "".join(old)
            new = self.counter.cut(before[: start - origin] + replacement + before[end - origin :])
            # The first new piece that begins where an old one does; text close to the cut end may still change.
            place, keep, stop = origin, 0, None
            limit = at + shift if whole else at + shift - self.counter.context
            for n, p in enumerate(new):
                if place - shift in begins and place <= limit and place >= start + len(replacement):
                    keep, stop = n, begins[place - shift]
                    break
                place += len(p)
            if stop is not None:
                new = new[:keep]
                break
            if whole:
                break
            want *= 2
        self.encoded_chars += sum(map(len, new))
        last = stop[0] if stop else len(self.pieces) - 1
        tail = stop[1] if stop else len(self.row(last))
        fresh_counts = self.counter.counts(new)
        rows = self.row(first)[:skip] + new + self.row(last)[tail:]
        counts = self.counts[first][:skip] + fresh_counts + self.counts[last][tail:]
        for i in range(first, last + 1):
            self.pieces[i], self.counts[i] = (rows, counts) if i == first else ([], [])
        if len(rows) > 8 * LEAF:
            # A large insertion: spread the leaf; counts are kept.
            leaves = [(self.row(i), self.counts[i]) for i in range(len(self.pieces))]
            self._build([(p[k : k + LEAF], n[k : k + LEAF]) for p, n in leaves for k in range(0, len(p), LEAF)])
            return
        touched = set()
        for i in range(first, last + 1):
            at = i + self.size
            self.chars[at], self.tokens[at] = sum(map(len, self.pieces[i])), sum(self.counts[i])
            touched.add(at // 2)
        while touched and touched != {0}:
            for i in touched:
                self._pull(i)
            touched = {i // 2 for i in touched if i > 1}


EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("replacement", T.StringType())]))
TREE = [T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))]
FIELDS = [T.StructField("before", T.LongType()), T.StructField("after", T.LongType()), T.StructField("encoded_chars", T.LongType()), T.StructField("edited", T.StringType()), T.StructField("tree", T.StructType(TREE))]


def _trees(states: list[tuple[np.ndarray, np.ndarray]]) -> pa.StructArray:
    ends = np.cumsum([0, *(len(sizes) for sizes, _ in states)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[i] for x in states] or [np.zeros(0, np.int32)]).astype(np.int32))) for i in (0, 1)]
    return pa.StructArray.from_arrays(lists, names=["sizes", "tokens"])


def index(docs: DataFrame, tokenizer_path: str, text_col: str = "text", into: str = "tree") -> DataFrame:
    """Adds the struct ``into``: the characters and tokens of every pre-token. Null and empty texts have none."""

    def make():
        counter = PieceCounter(codec(tokenizer_path))

        def handle(texts):
            pieces = [counter.cut(t or "") for t in texts]
            trees = _trees([(np.fromiter(map(len, p), np.int32, len(p)), np.array(counter.counts(p), np.int32)) for p in pieces])
            return [trees.field(0), trees.field(1)]

        return handle

    return append_struct(docs, text_col, TREE, into, make)


def recount(docs: DataFrame, edits: str, tokenizer_path: str, text_col: str = "text", into: str = "recount", tree: str | None = None, keep: Sequence[str] | None = None, new_tree: bool = True) -> DataFrame:
    """Adds the struct ``into``: tokens before and after the edits of the array column ``edits``, characters that were encoded for them, the edited text and its tree.

    ``tree`` names a column that ``index`` or an earlier ``recount`` has made; without one, or where it is null, the text is cut
    and counted first. A row for every row; other columns stay as they are (with ``keep`` those only), and ``into`` must not be one of them
    (``ValueError``). ``new_tree`` tells whether the result has the edited text's tree.
    """
    names = list(docs.columns if keep is None else keep)
    fields = FIELDS if new_tree else FIELDS[:-1]
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into} exists already; use fresh()")

    def make():
        counter = PieceCounter(codec(tokenizer_path))

        def trees(batch: pa.RecordBatch) -> Iterator[CountTree]:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            known = [None] * len(texts)
            if tree is not None:
                column = batch.column(batch.schema.get_field_index(tree))
                known = [None if not c.is_valid else tuple(np.asarray(c[name].values.to_numpy(zero_copy_only=False)) for name in ("sizes", "tokens")) for c in column]
            for text, state in zip(texts, known, strict=True):
                yield CountTree(text, counter) if state is None else CountTree.kept(text, *state, counter)

        def handle(batch: pa.RecordBatch):
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for now, todo in zip(trees(batch), batch.column(batch.schema.get_field_index(edits)).to_pylist(), strict=True):
                out[0].append(now.total)
                for e in todo or ():
                    if e is not None:
                        now.edit(e["start"] or 0, e["start"] or 0 if e["end"] is None else e["end"], e["replacement"] or "")
                out[1].append(now.total), out[2].append(now.encoded_chars), out[3].append(now.text)
                if new_tree:
                    out[4].append(now.state())
            packed = pa.StructArray.from_arrays([*[pa.array(np.array(x, np.int64)) for x in out[:3]], pa.array(out[3], pa.string()), *([_trees(out[4])] if new_tree else [])], names=[f.name for f in fields])
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], packed], names=[*names, into])

        return handle

    return map_slices(docs, T.StructType([*[docs.schema[c] for c in names], T.StructField(into, T.StructType(fields))]), make)


def sample_edits(text: Column) -> Column:
    """A fixed script for any text: an insertion at a third, a deletion of twenty characters in the middle, new first characters."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    part = lambda start, end, s: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(s).alias("replacement"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(part(third, third, " (revised)"), part(half, half + 20, ""), part(F.lit(0), F.lit(5), "Note: "))

