import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm.bpe import Memo, codec, round_trip
from tessella.llm.queries import op2_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
C, REF = codec(PATH), Tokenizer.from_file(PATH)


def same(text):
    ids = C.encode(text)
    ref = REF.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == ref
    assert C.decode(ids) == REF.decode(ref, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("abstEéö'’ж中🙂　\x85\x1c\t\n  19½!?.#|<>"), max_size=60))
def test_equals_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "\n \n x", "a  b", "x ", " <|endoftext|> y<|endoftext|>", "it's we'll I'd", "Thnd*** ndea$$$"])
def test_corner_texts(text):
    same(text)


def test_random_words_equal_the_library():
    rng = random.Random(3)
    parts = "th er on ing tion ß ü ción aux 's !! *** ### 12".split()
    for _ in range(500):
        same(" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(20)))


def test_memo_keeps_values_when_it_turns_over():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, most=3)
    assert [memo[k] for k in (1, 2, 3, 4, 1, 5, 6, 1)] == [2, 4, 6, 8, 2, 10, 12, 2]
    assert len(memo) <= 3


def test_operator_on_nulls_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "the the", 7), (3, "the the", 7)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, r.bpe.decoded, len(r.bpe.ids) // 4, r.ids) for r in round_trip(docs, PATH).collect()}
    assert rows == {(1, "", 0, 5), (2, "", 0, 6), (3, "the the", 2, 7)}
    assert round_trip(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        round_trip(docs, PATH, into="IDS")


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = REF.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(REF.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memos_do_not_keep_long_pieces():
    C.encode("q" * 70 + " " + "z" * 3000)
    assert all(len(k) <= 64 for memo in (C.words, C.first, C.later) for k in memo)
