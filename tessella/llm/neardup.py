"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A document is the bag of its five-word shingles. Its weighted Jaccard similarity to another is the
sum of the smaller multiplicities over the sum of the larger ones.

BagMinHash: each shingle has a Poisson process over time and weight, the same in every document.
Weights are discretised to integers and form a hierarchy: the first unit, then the octaves [1, 2),
[2, 4), [4, 8) and so on, each a process of its own whose points fall to the octave's units by
further bits of their hash. A document sees the points below its own multiplicity. Every point also
picks one of ``COMPONENTS`` places at random, and each place keeps its earliest point; a process is
read only while it can still beat the latest of them. Two documents agree in a place with a
probability equal to their similarity.

Documents with equal words are one node from the start, so exact copies cost one row each; nodes are numbered. Nodes
that share a band of the signature are a bucket. A bucket is a star around its least node, never all its pairs. Every
link of a star is verified by the two whole bags, and verified links alone make components. What a star does not say is
whether two members that are not linked to the centre are similar: buckets of three nodes and more whose members
are still of several components are compared in full. Their members are dealt to blocks of bounded size, pairs of blocks are
joined by key, and a block pair counts all overlaps at once as products of indicator matrices. Buckets with the same
members are compared once. Classes are the components of all verified links, so no link that a band shows is
lost, whatever the bucket's size, and unrelated documents that share a band by chance are never joined.

``BANDS`` bands of ``ROWS`` places meet for a pair of similarity 0.8 with probability 0.998 and for one of 0.3 with 0.015.

Texts without words are a class each. Texts of one to four words have one shingle of all their words.
Rows without an id take part as exact copies only. A class is named by its smallest id. Repeated rows are exact copies. An
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, batches_of, fresh, map_slices, stash, unstash
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 6
COMPONENTS = BANDS * ROWS
#: Bounds of a block of a bucket: documents and bytes of bags, both met on average.
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
#: Columns of an indicator matrix at a time.
COLUMNS = 4096
#: Rows of an Arrow batch of pairs of bags, and of pairs of blocks.
PAIRS, BLOCK_PAIRS = 1024, 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str]) -> np.ndarray:
    """A 64-bit hash of every run of five words; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + h[j : len(h) - n + 1 + j] + _GOLD)
    return out


def occurrences(h: np.ndarray) -> np.ndarray:
    """The bag as a sorted set: the k-th occurrence of a shingle is an element of its own."""
    keys, counts = np.unique(h, return_counts=True)
    more = np.flatnonzero(counts > 1)
    if not len(more):
        return keys
    extra = [mix(keys[i] + _GOLD * np.arange(1, counts[i], dtype=np.uint64)) for i in more]
    return np.sort(np.concatenate([keys, *extra]))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags as given by ``occurrences``."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


def signatures(bags: list[np.ndarray], m: int = COMPONENTS) -> np.ndarray:
    """The earliest point (as the bits of its time) in each of ``m`` places for each bag of shingle hashes."""
    keys, weights, docs = [], [], []
    for i, h in enumerate(bags):
        k, w = np.unique(h, return_counts=True)
        keys.append(k), weights.append(w), docs.append(np.full(len(k), i))
    best = np.full((len(bags), m), np.inf)
    if not keys or not sum(map(len, keys)):
        return best.view(np.uint64)
    key, weight, doc = np.concatenate(keys), np.concatenate(weights), np.concatenate(docs)
    # One process per shingle and level: level 0 is the first unit, level j >= 1 the units from 2^(j-1) to 2^j.
    parts = [(key, weight, doc, np.zeros(len(key), np.int64))]
    level = 1
    while (more := weight > 1 << (level - 1)).any():
        parts.append((key[more], weight[more], doc[more], np.full(more.sum(), level)))
        level += 1
    key, weight, doc, levels = (np.concatenate(x) for x in zip(*parts, strict=True))
    width = np.where(levels == 0, 1, 1 << np.maximum(levels - 1, 0))
    low = np.where(levels == 0, 0, width)
    seed = mix(key + _GOLD * (levels.astype(np.uint64) + np.uint64(1)))
    time, flat = np.zeros(len(key)), best.reshape(-1)
    point = 0
    while len(key):
        point += 1
        bits = mix(seed + np.uint64(int(_GOLD) * point & 0xFFFFFFFFFFFFFFFF))
        more_bits = mix(bits + _GOLD)
        time = time - np.log(((bits >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / width
        unit = low + ((more_bits >> np.uint64(32)).astype(np.int64) & (width - 1))
        seen = unit < weight
        place = doc * m + (more_bits & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        np.minimum.at(flat, place[seen], time[seen])
        live = time < best.max(axis=1)[doc]
        key, weight, doc, width, low, seed, time = (x[live] for x in (key, weight, doc, width, low, seed, time))
    return best.view(np.uint64)


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of ``ROWS`` places each."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(signature), BANDS)).copy()
    for j in range(ROWS):
        out = mix(out * _GOLD + signature[:, j::ROWS])
    return out.view(np.int64)


def keys_of(texts: list[list[str]]) -> list[pa.Array]:
    """128 bits that name a list of words, as two numbers; null without words."""
    both = [np.frombuffer(xxhash.xxh3_128_digest(" ".join(w)), ">i8").tolist() if w else (None, None) for w in texts]
    return [pa.array([k[i] for k in both], pa.int64()) for i in (0, 1)]


def _words(texts: pa.Array) -> list[list[str]]:
    return [WORD.findall(t.lower()) if t else [] for t in texts.to_pylist()]


def _sign():
    def handle(batch: pa.RecordBatch):
        words = _words(batch.column(2))
        long = [i for i, w in enumerate(words) if len(w) > SHINGLE]
        bands: list = [None] * len(words)
        if long:
            for i, b in zip(long, band_hashes(signatures([shingles(words[i]) for i in long])), strict=True):
                bands[i] = b
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *keys_of(words), pa.array(bands, pa.list_(pa.int64()))], names=["id", "row", "high", "low", "bands"])

    return handle


def _bag():
    def handle(batch: pa.RecordBatch):
        words = _words(batch.column(0))
        yield pa.RecordBatch.from_arrays([*keys_of(words), pa.array([occurrences(shingles(w)).tobytes() for w in words], pa.binary())], names=["high", "low", "bag"])

    return handle


def _verify(threshold: float):
    """Of pairs (a, b, bag of a, bag of b) those with at least ``threshold`` similarity."""

    def run(batches):
        for batch in batches:
            bags = [[np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3)]
            held = pa.array([similarity(x, y) >= threshold - 1e-12 for x, y in zip(*bags, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(held)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Common elements of every pair of sorted sets, as sums of products of indicator matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    elements = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    common = np.intersect1d(np.unique(elements[0]), np.unique(elements[1]), assume_unique=True)
    sides = []
    for x, whole in zip((left, right), elements, strict=True):
        owner = np.repeat(np.arange(len(x)), [len(a) for a in x])
        at = np.searchsorted(common, whole)
        at[at == len(common)] = 0
        hit = common[at] == whole if len(common) else np.zeros(len(whole), bool)
        sides.append((owner[hit], at[hit]))
    for start in range(0, len(common), COLUMNS):
        parts = []
        for (owner, at), x in zip(sides, (left, right), strict=True):
            mine = (at >= start) & (at < start + COLUMNS)
            m = np.zeros((len(x), min(COLUMNS, len(common) - start)), np.float32)
            m[owner[mine], at[mine] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def forest(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Those of the pairs that join two parts; they connect all that the pairs connect."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def block_links(left: list[dict], right: list[dict] | None, threshold: float) -> list[tuple[int, int]]:
    """Links that connect the documents of a block, or of two blocks, with at least ``threshold`` similarity and of different components."""
    same = right is None
    right = left if same else right
    bags = [[np.frombuffer(r["bag"], np.uint64) for r in side] for side in (left, right)]
    both = overlaps(*bags)
    sizes = [np.array([len(b) for b in side], np.float64) for side in bags]
    similar = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-6
    similar &= np.array([r["component"] for r in left])[:, None] != np.array([r["component"] for r in right])[None, :]
    rows, columns = np.nonzero(np.triu(similar, 1) if same else similar)
    shift = 0 if same else len(left)
    nodes = [r["node"] for r in left] + ([] if same else [r["node"] for r in right])
    return [(nodes[a], nodes[b]) for a, b in forest([(int(a), int(b) + shift) for a, b in zip(rows, columns, strict=True)], len(nodes))]


def _link(threshold: float):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                left, right = (batch.column(i)[at].as_py() for i in (0, 1))
                found = block_links(left, right, threshold)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    return run


def _compare_in_full(members: DataFrame, linked: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a bucket that are of different components; buckets of two are settled by their star."""
    parts = members.where("n > 2").join(linked, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    mixed = parts.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")).where("least < most")
    # Of buckets with the same members one is compared.
    todo = mixed.groupBy("n", "sum").agg(F.min("band").alias("band")).select("band")
    held = stash(parts.join(todo, "band").join(bags, "node"), "mixed")
    sizes = held.groupBy("band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.octet_length("bag")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = held.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    packed = stash(dealt.groupBy("band", "blocks", "block").agg(F.collect_list(F.struct("node", "component", "bag")).alias("docs")), "packed")
    unstash(held)
    alone = packed.select(F.col("docs").alias("left"), F.lit(None).cast(packed.schema["docs"].dataType).alias("right"))
    left = packed.where("block + 1 < blocks").select("band", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("block"), F.col("docs").alias("left"))
    pairs = left.join(packed.select("band", "block", F.col("docs").alias("right")), ["band", "block"]).select("left", "right")
    with batches_of(members.sparkSession, BLOCK_PAIRS):
        out = stash(alone.union(pairs).mapInArrow(_link(threshold), "a long, b long"), "links")
    unstash(packed)
    return out


def _grouped(source: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """From ``id, row, text``: a row per document ``id, row, node, group``, and the groups that hold several nodes ``group, least``; both stashed."""
    id_type = source.schema["id"].dataType.simpleString()
    signed = stash(map_slices(source, f"id {id_type}, row long, high long, low long, bands array<long>", _sign), "signed")
    named = signed.where("high is not null").groupBy("high", "low").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"))
    # Numbers are given before the nodes are written, so that a lost task's nodes keep their numbers.
    nodes = stash(named.select(F.monotonically_increasing_id().alias("node"), "high", "low", "rep", "bands"), "nodes")
    spread = nodes.where("rep is not null and bands is not null").select("node", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stash(spread.join(buckets, "band"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep", "high", "low"), "node")
    texts = source.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("text")
    bags = stash(map_slices(texts, "high long, low long, bag binary", _bag).join(wanted.select("node", "high", "low"), ["high", "low"]).dropDuplicates(["node"]).select("node", "bag"), "bags")
    stars = members.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = stars.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")
    with batches_of(source.sparkSession, PAIRS):
        sure = stash(pairs.mapInArrow(_verify(threshold), "a long, b long"), "links")
    linked = components(sure)
    more = _compare_in_full(members, linked, bags, threshold)
    for done in (members, bags, sure):
        unstash(done)
    if more.limit(1).count():
        before, linked = linked, components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
        unstash(before)
    unstash(more)
    groups = stash(linked.join(nodes.select("node", "rep"), "node").select("node", F.col("component").alias("group"), "rep"), "groups")
    unstash(linked)
    least = stash(groups.groupBy("group").agg(F.min("rep").alias("least")), "least")
    all_nodes = nodes.select("node", "high", "low", "rep").join(groups.select("node", "group"), "node", "left").select("high", "low", "rep", F.coalesce("group", "node").alias("group"))
    rows = stash(signed.select("id", "row", "high", "low").join(all_nodes, ["high", "low"], "left").select("id", "row", "group", "rep"), "rows")
    for done in (signed, nodes, groups):
        unstash(done)
    return rows, least


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id, class_id``: a row per row of ``docs``; a text without words has its own id as class."""
    rows, least = _grouped(docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("row"), F.col(text_col).alias("text")), threshold)
    out = stash(rows.join(least, "group", "left").select("id", F.when(F.col("group").isNull(), F.col("id")).otherwise(F.coalesce("least", "rep")).alias("class_id")), "classes")
    unstash(rows)
    unstash(least)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without near copies: of each class the row with the smallest id stays, rows without an id last.

    Exactly one row stays, also of repeated rows. Texts without words are no copies of anything and all stay.
    Columns stay as they are, whatever their names.
    """
    row, number = fresh(docs, "_row"), fresh(docs, "_id")
    marked = docs.withColumn(row, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
    rows, least = _grouped(marked.select(F.col(id_col).alias("id"), F.col(row).alias("row"), F.col(text_col).alias("text")), threshold)
    unstash(least)
    repeats = rows.where("group is not null").groupBy("group", "id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = repeats.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row", "n")).alias("first")).select("first.id", "first.row", "first.n")
    wordless = rows.where("group is null").select("id", "row").distinct().select("id", "row", F.lit(1).cast("long").alias("n"))
    kept = stash(first.union(wordless).select(F.col("id").alias(number), F.col("row").alias("row"), "n"), "kept")
    unstash(rows)

    def those(condition: str) -> DataFrame:
        side = kept.where(condition).select(F.col(number).alias("_i"), F.col("row").alias("_r"))
        return marked.join(side, marked[id_col].eqNullSafe(side["_i"]) & (marked[row] == side["_r"]), "left_semi")

    out = those("n = 1")
    if kept.where("n > 1").limit(1).count():
        out = out.unionByName(those("n > 1").dropDuplicates([row]))
    return out.drop(row)
