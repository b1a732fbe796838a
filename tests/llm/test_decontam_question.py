import numpy as np

from tessella.llm import decontam
from tessella.llm.common import WORD

from .test_decontam import contained, corpus


def test_a_question_without_its_answer_is_a_leak():
    question, answer = "what is the name of the river here", "it is called the long one"
    index = decontam.ItemIndex([(1, f"{question}? {answer}", question, answer), (2, "too short. but the answer goes on and on for a while", "too short", "")], by_question=True)
    asked, whole, answered, short = index.leaks([f"so {question}", f"{question}? {answer}", answer, "this is too short"])
    assert [(x[0], x[3], x[4]) for x in asked] == [(1, 1.0, 0.0)]
    assert [(x[0], *x[2:]) for x in whole] == [(1, 1.0, 1.0, 1.0)]
    assert answered == short == []


def test_words_of_a_question_that_no_item_has_match_nothing():
    index = decontam.ItemIndex([(1, "river bank of the north side", "river aa bb cc dd ee", "")], by_question=True)
    assert index.leaks(["river vv ww xx yy zz", "river bank"]) == [[], []]


def test_question_leaks_equal_brute_force_over_all_pairs():
    items, docs = corpus(4)
    rng = np.random.default_rng(8)
    for d in range(0, 120, 4):  # questions alone, some with changed words
        words, leak = WORD.findall(docs[d][1].lower()), WORD.findall(decontam.split_item(items[int(rng.integers(25))][1])[0])
        for _ in range(d // 4 % 3):
            leak[int(rng.integers(len(leak)))] = "changed"
        at = int(rng.integers(len(words)))
        docs[d] = (d, " ".join(words[:at] + leak + words[at:]))
    whole, either = (decontam.ItemIndex([(i, t, *decontam.split_item(t)) for i, t in items], by_question=b) for b in (False, True))
    before, got = ({(d, x[0]) for (d, _), found in zip(docs, index.leaks([t for _, t in docs]), strict=True) for x in found} for index in (whole, either))
    step, want = 2 * either.longest, set()
    for d, text in docs:
        words = WORD.findall(text.lower())
        for at in range(0, max(1, len(words)), step):
            passage = words[at : at + 2 * step]
            want |= {(d, i) for i, t in items if max(contained(t, passage), contained(decontam.split_item(t)[0], passage)) >= 0.8}
    assert got == want and before < got
