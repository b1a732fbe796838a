import numpy as np
import pytest

from tessella.llm import licenses
from tessella.llm.common import WORD
from tessella.llm.queries import op5_licenses

INDEX = licenses.LicenseIndex()


def common(a, b):
    """Longest common subsequence of two word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j] + (x == y), row[j + 1], new[j]))
        row = new
    return row[-1]


def noise(rng, n):
    return " ".join(rng.choice(["lomi", "rata", "of", "the", "and", "semo", "is", "to"], n))


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_template_is_found_whole_and_edited(name):
    rng = np.random.default_rng(len(name))
    words = licenses.TEMPLATES[name].split()
    before, after = noise(rng, 50), noise(rng, 30)
    text = f"{before}\n{' '.join(words)}\n{after}"
    found = INDEX.scan(text)
    assert [(m[0], m[1]) for m in found if m[0] == name] == [(name, 1.0)]
    match = next(m for m in found if m[0] == name)
    assert WORD.findall(text[match[3] : match[4]].lower()) == WORD.findall(licenses.TEMPLATES[name].lower())
    if len(words) >= 12:
        edited = list(words)
        for at in rng.choice(len(words), len(words) // 12, replace=False):
            edited[at] = "changed"
        edited[len(words) // 2 : len(words) // 2] = ["put", "in"]
        match = next(m for m in INDEX.scan(f"{before} {' '.join(edited)} {after}") if m[0] == name)
        want = common(WORD.findall(licenses.TEMPLATES[name].lower()), WORD.findall(" ".join(edited).lower()))
        assert 0.8 <= match[1] <= 1 and match[2] == want


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 9, licenses.GRAM + licenses.WINDOW - 1)
    for _ in range(200):
        a, b = (np.concatenate([rng.integers(0, 9, 6), shared, rng.integers(0, 9, 6)]) for _ in range(2))
        assert set(licenses.fingerprints(a)[1].tolist()) & set(licenses.fingerprints(b)[1].tolist())


def test_repeats_empty_and_clean_texts():
    rng = np.random.default_rng(0)
    text = "All rights reserved. x y z. All rights reserved! " + noise(rng, 40)
    assert [(m[0], m[3], m[4]) for m in INDEX.scan(text)] == [("All-rights-reserved", 0, 19), ("All-rights-reserved", 28, 47)]
    assert INDEX.scan(None) == [] and INDEX.scan("") == [] and INDEX.scan("?!") == []
    assert INDEX.scan(noise(rng, 20_000)) == []
    assert licenses.LicenseIndex({}).scan("All rights reserved") == []
    assert [m[0] for m in licenses.LicenseIndex({"one": "Proprietary"}).scan("a proprietary text")] == ["one"]


def test_longer_notice_wins_over_a_shorter_one_within():
    assert [m[0] for m in INDEX.scan(licenses.TEMPLATES["Apache-2.0"])] == ["Apache-2.0"]
    assert [m[0] for m in INDEX.scan("x Licensed under the Apache License, Version 2.0. y")] == ["Apache-2.0-notice"]


def test_operator_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "Released under the MIT License.", "b"), (2, "Released under the MIT License.", "b")], "doc_id long, text string, found string")
    rows = sorted((r.doc_id, [x.license for x in r.licenses.found], r.found) for r in licenses.scan(df).collect())
    assert rows == [(1, [], "a"), (2, ["MIT-notice"], "b"), (2, ["MIT-notice"], "b")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf):
    """Every window of a document against every template, by common subsequence."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in op5_licenses(spark, sf).collect()}
    want = set()
    short = {n: WORD.findall(t.lower()) for n, t in licenses.TEMPLATES.items() if len(t.split()) < 15}
    for d, text in texts.items():
        words = WORD.findall(text.lower())
        for n, t in short.items():
            if any(w in words for w in t if len(w) > 6 or w in ("mit", "cc")) and any(common(t, words[i : i + len(t)]) >= 0.8 * len(t) for i in range(len(words))):
                want.add((d, n))
    assert got == want and got
