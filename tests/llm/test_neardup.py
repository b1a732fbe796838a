from collections import Counter

import numpy as np
import pytest

from tessella.llm import graph, neardup
from tessella.llm.common import WORD
from tessella.llm.queries import op7_neardup


def bag(text):
    words = WORD.findall(text.lower())
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def weighted(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """Class of each row by comparing all pairs."""
    bags, parent = [bag(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and weighted(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, least[root(i)]) for i, (d, _) in enumerate(rows)]


def corpus(seed=4):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, next_id = [], 1

    def add(text):
        nonlocal next_id
        rows.append((next_id, text))
        next_id += 1

    for _ in range(12):
        base = list(rng.choice(vocabulary, 120))
        add(" ".join(base))
        for changes in (1, 1, 2, 3, 6, 15):
            copy = list(base)
            for at in rng.integers(0, 120, changes):
                copy[at] = "changed"
            add(" ".join(copy))
        add(" ".join(base).upper() + "!")
    for _ in range(3):
        add("line of text that repeats " * 30)
        add("line of text that repeats " * 29 + "end")
        add("line of text that repeats " * 10)
    for t in (None, None, "", "...", "one", "one", "two words", "a b c d", "a b c d e"):
        add(t)
    return rows


def test_signature_agreement_equals_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    x, y = np.repeat(a, rng.integers(0, 12, 300)), np.repeat(a, rng.integers(0, 12, 300))
    want = neardup.similarity(neardup.occurrences(x), neardup.occurrences(y))
    s = neardup.signatures([x, y], m=4096)
    assert (s[0] == s[1]).mean() == pytest.approx(want, abs=4 * np.sqrt(want * (1 - want) / 4096))


def test_signature_of_a_bag_does_not_depend_on_its_company():
    bags = [neardup.shingles(f"{i} b c d e f g h i j".split()) for i in range(5)]
    together = neardup.signatures(bags)
    assert all((neardup.signatures([b])[0] == s).all() for b, s in zip(bags, together, strict=True))
    assert neardup.signatures([]).shape == (0, neardup.COMPONENTS)


def test_similarity_equals_counters():
    for a, b in (("a b c d e f", "a b c d e g"), ("x " * 50, "x " * 40), ("a", "a"), ("a b", "b a"), ("", "a")):
        x, y = (neardup.occurrences(neardup.shingles(t.split())) for t in (a, b))
        assert neardup.similarity(x, y) == pytest.approx(weighted(bag(a), bag(b)))


def test_classes_equal_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.id, r.class_id) for r in neardup.classes(df).collect()) == brute(rows)


def test_a_chain_whose_ends_differ_is_one_class(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i + 1, " ".join(words[i * 8 : i * 8 + 100])) for i in range(12)]
    got = sorted((r.id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and {c for _, c in got} == {1}


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (7, None), (None, None)], "doc_id long, text string")
    got = sorted(((r.id, r.class_id) for r in neardup.classes(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (7, 7), (None, None)], key=str)
    assert neardup.classes(df.limit(0)).count() == 0


def test_keep_one_keeps_columns_and_a_row_of_each_class(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, _kept string")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute(rows)})


def test_keep_one_keeps_one_of_repeated_rows_and_of_rows_without_an_id(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text), (None, None), (4, text), (6, "A b, c d e f g"), (6, "A b, c d e f g"), (9, None), (9, None), (8, "h i j"), (8, "h i j"), (None, "k l"), (None, "k l")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in neardup.keep_one(df).collect() if r.text) == [("4", text), ("8", "h i j"), ("None", "k l")]
    assert sorted(str(r.doc_id) for r in neardup.keep_one(df).collect() if not r.text) == ["9", "9", "None"]
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_members_that_the_centre_does_not_link_are_compared(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(24):  # changed places drift, so neighbours are similar and ends are not
        words = list(base)
        for at in range(i * 4, i * 4 + 5):
            words[at % 100] = f"x{at}"
        rows.append((i + 1, " ".join(words)))
    got = sorted((r.id, r.class_id) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_blocks_compare_all_pairs_of_different_components():
    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    docs = [{"node": i, "component": i // 2, "bag": b.tobytes()} for i, b in enumerate(bags)]
    want = {frozenset((i, j)) for i in range(12) for j in range(i) if i // 2 != j // 2 and neardup.similarity(bags[i], bags[j]) >= 0.4}
    parts = [neardup.block_links(docs[:5], None, 0.4), neardup.block_links(docs[5:], None, 0.4), neardup.block_links(docs[:5], docs[5:], 0.4)]
    found = {frozenset(x) for p in parts for x in p}
    assert found <= want
    assert len(neardup.forest([tuple(x) for x in found], 12)) == len(neardup.forest([tuple(x) for x in want], 12))


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.class_id) for r in op7_neardup(spark, sf).collect()) == sorted(brute(rows))


def test_recall_of_planted_near_copies(spark):
    """Copies with so many changed words that similarities are from just 0.8 on up."""
    rng = np.random.default_rng(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, pairs = [], []
    for i in range(250):
        base = list(rng.choice(vocabulary, int(rng.integers(60, 300))))
        copy = list(base)
        for at in rng.integers(0, len(base), max(1, int(len(base) * rng.uniform(0, 0.022)))):
            copy[at] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        if 0.8 <= weighted(bag(rows[-2][1]), bag(rows[-1][1])):
            pairs.append(2 * i)
    found = {r.id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 150
    assert np.mean([found[i] == found[i + 1] for i in pairs]) >= 0.98
    assert all(found[2 * i] != found[2 * i + 1] for i in range(250) if 2 * i not in pairs)
