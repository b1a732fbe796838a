"""Byte-level BPE: exact backtracking encoder and offset-table decoder.

The encoder never runs merges. An Aho-Corasick automaton of the vocabulary scans each pre-token once and so finds the
longest entry that begins at each of its bytes; at a place that is reached it is tried first and kept only if it can stand
next to the entry before it, that is if merging would not have joined bytes across their border.
Where no entry fits, the last one is taken back. A bit per position keeps dead ends from being
entered twice, so the time is linear in the length of the pre-token.

Null texts count as empty. Empty texts give no ids. Repeated rows are encoded each on its own.
The text of a special token inside a document gives the special id, as the tokenizers library does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_struct

#: Unicode White_Space, and the pre-token pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Entries of one generation of a worker's memo of encoded pieces.
MEMO = 120_000
#: Pieces longer than this are not kept, so a memo is bounded in bytes too.
MEMO_PIECE = 64


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: a byte that prints stands for itself, the others follow from code 256 on."""
    prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class Memo(dict):
    """Bounded memo of two generations: when full, the young one becomes the old one, whose entries return on use.

    Keys longer than ``longest`` are not kept, so the memo is bounded in bytes as well as in entries.
    """

    def __init__(self, make, most: int = MEMO, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # Entries are renumbered by age: single bytes first, then merges in order.
        age = {c: b for c, b in alphabet.items()}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        ids, texts = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])], [bytes([b]) for b in range(256)]
        for left, right in merges:
            if left + right in age:
                continue
            now = age[left + right] = len(self.parts)
            self.parts.append((age[left], age[right]))
            self.joined[age[left], age[right]] = now
            ids.append(vocab[left + right])
            texts.append(to_bytes(left + right))
        self.packed, self.sizes = [i.to_bytes(4, "little") for i in ids], [len(t) for t in texts]
        by_text = {t: a for a, t in enumerate(texts)}
        # The next shorter entry that begins a given entry, or -1.
        self.shorter = [next((by_text[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_text), -1) for t in texts]
        self.matcher = ahocorasick.Automaton()
        for a, t in enumerate(texts):
            self.matcher.add_word(t.decode("latin-1"), a)
        self.matcher.make_automaton()
        self.fits = Memo(self._fits, 150_000)
        # Offset table for decoding: bytes of id i are blob[offsets[i]:offsets[i + 1]].
        most = max([*vocab.values(), *self.specials.values()]) + 1
        pieces = [b""] * most
        for s, i in vocab.items():
            pieces[i] = to_bytes(s) if all(c in alphabet for c in s) else s.encode()
        for s, i in self.specials.items():
            pieces[i] = s.encode()
        self.offsets = np.zeros(most + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.pre_token = regex.compile(PRE_TOKEN)
        self.risky = re.compile(r" (?:\s|\Z)")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = Memo(self._word, 50_000, MEMO_PIECE)
        self.first = Memo(self._piece, 10_000, MEMO_PIECE)
        self.later = Memo(lambda piece: self._piece(" " + piece), MEMO, MEMO_PIECE)

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging leaves the border between two neighbouring entries alone.

        Undoes merges from the youngest on, always of the younger of the two entries at the
        border, and asks each time whether the parts that then meet would have been joined earlier.
        """
        left, right = pair
        joined, parts, most = self.joined, self.parts, len(self.parts)
        before = most
        while True:
            if joined.get((left, right), most) < before:
                return False
            for side in (0, 1) if left > right else (1, 0):
                if side == 0 and left > 255:
                    before, left = left, parts[left][1]
                    break
                if side == 1 and right > 255:
                    before, right = right + 1, parts[right][0]
                    break
            else:
                return True

    def encode_word(self, data: bytes) -> list[int]:
        """Ages of the entries of one pre-token."""
        n, sizes, shorter, fits = len(data), self.sizes, self.shorter, self.fits
        longest = [0] * n
        for end, entry in self.matcher.iter(data.decode("latin-1")):
            longest[end + 1 - sizes[entry]] = entry  # a later end of the same place is a longer entry
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, entry = 0, longest[0]
        while at < n:
            end = at + sizes[entry]
            if open_at[end] and (not out or fits[out[-1], entry]):
                out.append(entry)
                at = end
                if at < n:
                    entry = longest[at]
            elif shorter[entry] >= 0:
                entry = shorter[entry]
            else:
                # Nothing fits here: take the entry before back and try what is shorter than it.
                open_at[at] = 0
                entry = out.pop()
                at -= sizes[entry]
        return out

    def _word(self, word: str) -> bytes:
        packed = self.packed
        return b"".join([packed[a] for a in self.encode_word(word.encode())])

    def _piece(self, piece: str) -> bytes:
        if piece[:1] == " " and piece[1:].isalpha():
            return self._word(piece)
        return b"".join([self.words[w] for w in self.pre_token.findall(piece)])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.risky.search(text):
            return self._piece(text)
        # A blank before a non-blank always begins a pre-token, so pieces can be looked up on their own.
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self._plain(text)
        out, at = [], 0
        for m in found:
            out += [self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def count(self, text: str | None) -> int:
        return len(self.encode(text)) // 4

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return ""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    """One codec per worker process and vocabulary file."""
    return BytePairCodec(path)


def round_trip(docs: DataFrame, tokenizer_path: str, text_col: str = "text", into: str = "bpe") -> DataFrame:
    """Adds the struct ``into`` with ``ids`` (packed little-endian uint32) and ``decoded`` (text of those ids).

    A row for every row, other columns as they are; ``into`` must not be one of them (``ValueError``). Null and
    empty texts have no ids and an empty decoded text; an empty table gives an empty table.
    """

    def make():
        c = codec(tokenizer_path)

        def handle(texts):
            ids = [c.encode(t) for t in texts]
            return [pa.array(ids, pa.binary()), pa.array([c.decode(i) for i in ids], pa.string())]

        return handle

    return append_struct(docs, text_col, [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())], into, make)
