import zlib

import numpy as np
import pytest

from tessella.llm import quality, toxicity
from tessella.llm.queries import op9_quality, op10_toxicity

CLEAN = ["the river runs near town", "a boat on the lake", "bread and milk", "old trees by the road"]


def test_quality_learns_symbols_and_repeats():
    rng = np.random.default_rng(1)
    good = [" ".join(rng.permutation(" ".join(CLEAN).split())) for _ in range(40)]
    junk = [" ".join(w + "***" for w in t.split()) for t in good[:20]] + [" ".join(w for w in t.split() for _ in range(4)) for t in good[:20]]
    model = quality.train([(t, 1) for t in good] + [(t, 0) for t in junk], 0.5)
    one = model.scorer()
    assert min(map(one, good)) > 0.5 > max(map(one, junk))
    assert one("zebra zebra zebra zebra zebra") < one("river road lake bread milk")


def test_quality_features_equal_a_plain_definition():
    def plain(token):
        codes = [32, *map(ord, token), 32]
        yield zlib.crc32(token.encode()) % quality.BUCKETS
        for n in range(quality.SHORTEST, quality.LONGEST + 1):
            for i in range(len(codes) - n + 1):
                h = codes[i]
                for c in codes[i + 1 : i + n]:
                    h = (h * int(quality.MULTIPLIER) + c) % 2**32
                yield ((h ^ (h >> 15)) * int(quality.MULTIPLIER) % 2**32) >> int(quality.SHIFT)

    edge = quality.PIECE
    for text in ("a", "a bc", "é😀 \u00a0x\u2003boat", "w" * (edge - 2), "w" * (edge - 1) + " ab", "ab " * 3 + "x" * (2 * edge) + " a bc", f"{'y' * (edge - 4)} q r s t"):
        found = text.split()
        assert sorted(int(b) for part in quality.buckets(found) for b in part) == sorted(b for t in found for b in plain(t))
    assert list(quality.buckets([])) == []


def test_quality_score_equals_a_full_network_pass():
    samples = [("the boat the boat", 1), ("x*** y***", 0), ("a river", 1)]
    table, layer, bias = quality.network(samples, 2, 2.0, 5)
    one = quality.train(samples, 0.25, epochs=2).scorer()
    for text, tokens in (("the the boat", ["the", quality.REPEAT, "boat"]), ("y***", ["y***"]), ("w" * 9000, ["w" * 9000])):
        hidden = np.mean([table[f] for t in tokens for f in quality.features(t)], axis=0)
        z = hidden @ layer + bias + [0, np.log(0.25 / 0.75)]
        assert one(text) == pytest.approx(np.exp(z[1]) / np.exp(z).sum())


def test_rare_words_of_one_label_count():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(20)]
    text = lambda *more: " ".join([*rng.choice(words, 40), *more])
    clean, toxic = [text() for _ in range(400)], [text("brutish") for _ in range(390)] + [text("knavery") for _ in range(12)]
    one = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in toxic], 0.2).scorer()
    assert one(text("knavery")) > one(text()) + 0.1


def test_counts_in_chunks_equal_counts_at_once(monkeypatch):
    samples = [("a river boat", 0), ("the boats", 1), ("river river", 1), (None, 0), ("t" * 300, 1)]
    memo = lambda: toxicity.Memo(lambda w: np.fromiter(toxicity.grams(w), np.uint32))
    keys, counts = toxicity.frequencies(samples, memo())
    monkeypatch.setattr(toxicity, "CHUNK", 3)
    again = toxicity.frequencies(samples, memo())
    assert (keys == again[0]).all() and (counts == again[1]).all()
    for label in (0, 1):
        sets = [set().union(*map(toxicity.grams, toxicity.words_of(t))) for t, y in samples if y == label]
        assert counts[label].tolist() == [sum(int(k) in s for s in sets) for k in keys]


@pytest.mark.parametrize(("query", "kind", "label"), [(op9_quality, quality, "quality"), (op10_toxicity, toxicity, "toxic")])
def test_queries_score_every_row_by_the_model_of_the_training_rows(spark, sf, query, kind, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    one = kind.fit(labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").select("doc_id", label), docs.select("doc_id", "text")).scorer()
    rows = {r.doc_id: r for r in query(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for d, t in texts.items():
        assert rows[d].score == pytest.approx(one(t)) and rows[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert rows[d].predicted == int(rows[d].score >= (0.3 if kind is quality else 0.5))


def test_toxicity_finds_a_stem_in_a_long_text():
    rng = np.random.default_rng(2)
    words = " ".join(CLEAN).split()
    clean = [" ".join(rng.choice(words, 30)) for _ in range(80)]
    toxic = [f"{' '.join(rng.choice(words, 20))} vile{rng.choice(['ness', 'ly', ''])} {' '.join(rng.choice(words, 9))}" for _ in range(80)]
    model = toxicity.train([(t, 0) for t in clean] + [(t, 1) for t in toxic], 0.5)
    one = model.scorer()
    assert max(map(one, clean)) < 0.5 < min(map(one, toxic))
    assert one(" ".join(clean) * 20 + " VILEST, " + " ".join(clean)) > 0.5
    assert one("t" * 200_000) < 0.5
    by_hand = model.bias + sum(v for k, v in model.weights.items() if k in set().union(*map(toxicity.grams, toxicity.words_of(toxic[0]))))
    assert one(toxic[0]) == pytest.approx(1 / (1 + np.exp(-by_hand)))


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_without_both_labels_the_score_is_the_share(kind):
    assert kind.train([], 0.5).scorer()("text") == pytest.approx(0.5)
    assert kind.train([("a b", 1)], 0.9).scorer()(None) == pytest.approx(0.9)


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_operator_on_nulls_ties_repeats_and_clashes(spark, kind):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, "a boat", 0.3), (3, "a boat", 0.3)], "doc_id long, text string, score double")
    labelled = spark.createDataFrame([(1, 1), (2, None), (3, 0), (3, 1)], f"doc_id long, {'quality' if kind is quality else 'toxic'} int")
    model = kind.fit(labelled, docs)
    rows = kind.score(docs, model).orderBy("doc_id").collect()
    assert [r.score for r in rows] == [0.1, 0.2, 0.3, 0.3]
    assert rows[0].result.score == rows[1].result.score and rows[2].result == rows[3].result
    assert all(0 <= r.result.score <= 1 for r in rows)
    empty = kind.fit(labelled.limit(0), docs.limit(0))
    assert kind.score(docs.limit(0), empty).count() == 0


@pytest.mark.parametrize(("query", "label", "least"), [(op9_quality, "quality", 0.85), (op10_toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = query(spark, sf).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > least
