import numpy as np
import pytest

from tessella.llm import decontam
from tessella.llm.common import WORD
from tessella.llm.queries import op6_decontamination


def corpus(seed=2):
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"w{i}" for i in range(150)])
    weights = 1 / np.arange(1, 151)
    some = lambda n: list(rng.choice(vocabulary, n, p=weights / weights.sum()))
    items = [(i, " ".join(some(int(rng.integers(8, 50)))) + ". " + " ".join(some(6))) for i in range(25)]
    docs = []
    for d in range(120):
        words = some(int(rng.integers(1, 400)))
        if d % 3 == 0:
            leak = WORD.findall(items[int(rng.integers(25))][1])
            for _ in range(d % 4):
                leak[int(rng.integers(len(leak)))] = "changed"
            if d % 5 == 0:
                leak = leak[int(len(leak) * 0.15) :]
            at = int(rng.integers(len(words)))
            words[at:at] = leak
        docs.append((d, " ".join(words).upper() if d % 7 == 0 else "\n".join(words)))
    return items, docs


def contained(item, words):
    part = decontam.grams(WORD.findall(item.lower()))
    n = len(part[0]) if part else 5
    there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return sum(g in there for g in part) / len(part) if part else 0.0


def test_leaks_equal_brute_force_over_all_pairs():
    items, docs = corpus()
    index = decontam.ItemIndex([(i, t, *decontam.split_item(t)) for i, t in items])
    got = {(d, x[0]) for (d, _), found in zip(docs, index.leaks([t for _, t in docs]), strict=True) for x in found}
    step = 2 * index.longest
    want = set()
    for d, text in docs:
        words = WORD.findall(text.lower())
        for at in range(0, max(1, len(words)), step):
            want |= {(d, i) for i, t in items if contained(t, words[at : at + 2 * step]) >= 0.8}
    assert got == want and len(got) > 10


def test_wand_equals_scoring_every_item():
    items, docs = corpus(9)
    index = decontam.ItemIndex([(i, t, t, "") for i, t in items])
    index.threshold = [0.4 * t for t in index.threshold]
    index.lowest = min(index.threshold)
    found = 0
    for _, text in docs:
        terms = {index.vocabulary[w] for w in WORD.findall(text.lower()) if w in index.vocabulary}
        scores = {k: sum(v for t, v in impact.items() if t in terms) for k, impact in enumerate(index.impacts)}
        want = {k: s for k, s in scores.items() if s >= index.threshold[k]}
        got = dict(index.search(terms))
        assert got == pytest.approx(want)
        found += len(got)
    assert found > 100


def test_question_and_answer_overlap():
    index = decontam.ItemIndex([(1, "what is the name of the river here? it is called the long one", "what is the name of the river here", "it is called the long one")])
    (leak,) = index.leaks(["so what is the name of the river here? it is called the long one"])[0]
    assert leak[0] == 1 and leak[2:] == (1.0, 1.0, 1.0)
    assert index.leaks(["what is the name of the river here", None, "", "long"]) == [[], [], [], []]


def test_short_items_and_items_without_words():
    index = decontam.ItemIndex([(1, "one two", "one two", ""), (2, "!!", "!!", ""), (3, None, "", "")])
    assert [[x[0] for x in found] for found in index.leaks(["zero one two", "two one", "one", None])] == [[1], [], [], []]
    assert decontam.ItemIndex([]).leaks(["a"]) == [[]]


def test_operator_in_shards_with_clashes_and_repeats(spark):
    items, docs = corpus()
    i = spark.createDataFrame(items + items[:3], "item_id long, text string")
    d = spark.createDataFrame([(*x, "s") for x in docs] + [(999, None, "s"), (999, None, "s")], "doc_id long, text string, score string")
    one, many = (sorted((r.doc_id, sorted(x.item_id for x in r.leaks), r.score) for r in decontam.find_leaks(d, i, shard_chars=n).collect()) for n in (10_000_000, 2_000))
    assert one == many and len(one) == len(docs) + 2
    assert decontam.find_leaks(d.limit(0), i).count() == 0
    assert all(not r.leaks for r in decontam.find_leaks(d, i.limit(0)).collect())


def test_query_equals_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, t in items if contained(t, WORD.findall(r.text.lower())) >= 0.8}
    assert {(r.doc_id, r.item_id) for r in op6_decontamination(spark, sf).collect()} == want
