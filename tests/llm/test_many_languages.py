import numpy as np

from tessella.llm import langid
from tessella.llm.common import sample_texts


def test_every_language_gets_training_windows(monkeypatch):
    seen, real = [], langid.loss_and_gradients
    monkeypatch.setattr(langid, "loss_and_gradients", lambda m, x, y: (seen.append(y), real(m, x, y))[1])
    langid.train([(f"text {k}", f"l{k:03}") for k in range(150)], steps=3)
    counts = np.bincount(np.concatenate(seen), minlength=150)
    assert counts.min() >= 2 and counts.max() <= 3


def test_four_languages_train_as_before(monkeypatch):
    seen, real = [], langid.loss_and_gradients
    monkeypatch.setattr(langid, "loss_and_gradients", lambda m, x, y: (seen.append(y), real(m, x, y))[1])
    langid.train([(f"text {k}", f"l{k}") for k in range(4)], steps=3)
    assert all((y == np.arange(128) % 4).all() for y in seen)


def test_sample_has_every_label(spark):
    docs = spark.createDataFrame([(k, f"text {k}", f"l{k:03}") for k in range(205)], "doc_id long, text string, lang string").coalesce(1)
    assert {y for _, y in sample_texts(docs, docs, "doc_id", "lang", "text", 1, 100)} == {f"l{k:03}" for k in range(205)}


def test_sample_is_the_first_rows_of_each_label_in_any_partitioning(spark):
    rows = [(k, f"text {k}", "common" if k % 50 else "rare") for k in range(5000)] + [(3, "another text", "zzz"), (None, "no id", "rare"), (9000, None, "rare"), (9001, "t" * 200, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = sample_texts(docs.coalesce(1), docs, "doc_id", "lang", "text", 60, 100)
    assert one == sample_texts(docs.repartition(5), docs.repartition(3), "doc_id", "lang", "text", 60, 100)
    assert sum(y == "common" for _, y in one) == 60 and 58 <= sum(y == "rare" for _, y in one) <= 60
    assert sample_texts(docs.limit(0), docs, "doc_id", "lang", "text", 60, 100) == []
