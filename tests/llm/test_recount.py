import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import recount
from tessella.llm.bpe import codec

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = recount.PieceCounter(codec(PATH))
TEXT = st.text(alphabet=st.sampled_from("ab sl'\n\t1!é<|endoftx>  "), max_size=40)


def applied(text, start, end, new):
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    return text[:start] + new + text[end:]


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 45), st.integers(-2, 45), TEXT | st.just("<|endoftext|>")), max_size=5))
def test_edits_equal_counting_anew(text, edits):
    tree = recount.CountTree(text, COUNTER)
    for start, end, new in edits:
        tree.edit(start, end, new)
        text = applied(text, start, end, new)
        assert tree.text == text and tree.length == len(text)
        assert tree.total == codec(PATH).count(text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(-2, 400), st.integers(-2, 400), TEXT), max_size=4), st.integers(1, 30))
def test_kept_trees_equal_counting_anew(text, edits, times):
    text *= times
    tree = recount.CountTree(text, COUNTER)
    for start, end, new in edits:
        tree = recount.CountTree.kept(text, *tree.state(), COUNTER)
        assert tree.total == codec(PATH).count(text) and tree.encoded_chars == 0
        tree.edit(start, end, new)
        text = applied(text, start, end, new)
        assert tree.text == text and tree.total == codec(PATH).count(text)
    sizes, tokens = tree.state()
    assert sizes.sum() == len(text) and tokens.sum() == tree.total


def test_a_kept_tree_cuts_only_touched_leaves():
    text = " ".join(f"word{i}" for i in range(50_000))
    state = recount.CountTree(text, COUNTER).state()
    tree = recount.CountTree.kept(text, *state, COUNTER)
    tree.edit(100_000, 100_004, "new")
    assert sum(not isinstance(p, recount.Span) for p in tree.pieces) <= 3 and tree.encoded_chars < 60
    with pytest.raises(ValueError):
        recount.CountTree.kept(text + "x", *state, COUNTER)


def test_trees_of_the_operator_serve_the_next_edits(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "the river runs " * 90, "t")], "doc_id long, text string, sizes string").withColumn("edits", recount.sample_edits(F.col("text")))
    first = recount.recount(recount.index(df, PATH), "edits", PATH, tree="tree")
    again = first.select("doc_id", F.col("recount.edited").alias("text"), F.col("recount.tree").alias("tree")).withColumn("edits", recount.sample_edits(F.col("text")))
    for r in recount.recount(again, "edits", PATH, tree="tree").collect():
        assert r.recount.before == codec(PATH).count(r.text) and r.recount.after == codec(PATH).count(r.recount.edited)
    assert sorted((r.doc_id, r.recount.after) for r in first.collect()) == sorted((r.doc_id, r.recount.after) for r in recount.recount(df, "edits", PATH).collect())


def test_long_text_encodes_little_and_sums_hold():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "river", "don't", "12", "!!", "\n"]) for _ in range(20_000))
    tree = recount.CountTree(text, COUNTER)
    for _ in range(60):
        start = rng.randrange(len(text))
        end, new = start + rng.randrange(30), rng.choice(["", "x", " new words ", "'s", "  "])
        tree.edit(start, end, new)
        text = applied(text, start, end, new)
    assert tree.text == text and tree.total == codec(PATH).count(text)
    assert tree.encoded_chars < 60 * 150
    tree.edit(len(text) // 2, len(text) // 2, " word" * 5000)
    text = applied(text, len(text) // 2, len(text) // 2, " word" * 5000)
    assert tree.total == codec(PATH).count(text)
    for a, b in ((0, len(text)), (10, 5000), (700, 701)):
        starts, at, want = [], 0, 0
        for p in COUNTER.cut(text):
            want += COUNTER.memo[p] if a <= at < b else 0
            at += len(p)
            starts.append(at)
        assert tree.count(a, b) == want


def test_operator_on_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, [(0, 0, "a b")], 1), (2, "", None, 1), (3, "the river", [(4, 9, "boat"), None, (None, None, None)], 1), (3, "the river", [(4, 9, "boat"), None, (None, None, None)], 1)],
        "doc_id long, text string, edits array<struct<start: long, end: long, replacement: string>>, before int",
    )
    rows = recount.recount(df, "edits", PATH).orderBy("doc_id").collect()
    assert [(r.recount.before, r.recount.after, r.recount.edited) for r in rows] == [(0, 2, "a b"), (0, 0, ""), (2, 2, "the boat"), (2, 2, "the boat")]
    assert recount.recount(df.limit(0), "edits", PATH).count() == 0
    with pytest.raises(ValueError):
        recount.recount(df, "edits", PATH, into="before")


def test_query_equals_counting_the_edited_texts(spark, sf):
    from tessella.llm.queries import op8_recount

    c, ref = codec(PATH), Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_recount(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(t)
        t = applied(t, n // 3, n // 3, " (revised)")
        t = applied(t, n // 2, n // 2 + 20, "")
        t = applied(t, 0, 5, "Note: ")
        assert (r.n_tokens, r.n_tokens_after) == (c.count(texts[r.doc_id]), c.count(t)) == tuple(len(ref.encode(x, add_special_tokens=False).ids) for x in (texts[r.doc_id], t))
