import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessella.llm.common import WORD
from tessella.llm.queries import TOKENIZER

from .test_decontam import contained
from .test_neardup import brute


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_each_stage_keeps_columns_and_takes_effect(stages):
    counts = [s.count() for s in stages]
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert counts[0] >= counts[1] > counts[2] > counts[3] >= counts[4] == counts[5]


def test_clean_labelled_documents_pass_toxicity(spark, sf, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[2].select("doc_id").collect()}
    known = [(labels[r.doc_id], r.doc_id in kept) for r in stages[1].select("doc_id").collect() if r.doc_id in labels]
    assert np.mean([stays == (toxic == 0) for toxic, stays in known]) > 0.9


def test_near_copies_equal_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert {r.doc_id for r in stages[3].collect()} == {c for _, c in brute(rows)}


def test_leaks_equal_brute_force(spark, sf, stages):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in stages[3].collect() if not any(contained(t, WORD.findall(r.text.lower())) >= 0.8 for t in items)}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_tokens_equal_the_library(stages):
    ref = Tokenizer.from_file(TOKENIZER)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = ref.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (None, "The and of the thing", "en", "s", 0, "z"), (3, "The and of the thing", "en", "s", 0, "z")], "doc_id long, text string, lang string, source string, n_chars long, score string")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert {r.doc_id for r in now.collect()} <= {3, None}
