import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import langid
from tessella.llm.queries import op1_language

WORDS = {"aa": "lomi rata semo", "bb": "ürk zzöt vrrn"}


def texts(lang, n):
    rng = np.random.default_rng(n)
    return [" ".join(rng.choice(WORDS[lang].split(), 12)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return langid.train([(t, y) for y in WORDS for t in texts(y, 30)], steps=100)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    m = langid.ByteTagger(["a", "b"], rng.normal(0, 0.5, (2, 256, 6)), rng.normal(0, 0.5, (2, 3, 6)), rng.normal(0, 0.5, (2, 3, 2)), np.zeros(2))
    x, y = rng.integers(97, 100, (4, 7)), np.array([0, 1, 1, 0])
    x[2, 5:] = 0
    _, g = langid.loss_and_gradients(m, x, y)
    for name in ("table", "inner", "outer", "bias"):
        value = getattr(m, name)
        for i in range(0, value.size, max(1, value.size // 40)):
            at = np.unravel_index(i, value.shape)
            kept = value[at]
            value[at] = kept + 1e-5
            up = langid.loss_and_gradients(m, x, y)[0]
            value[at] = kept - 1e-5
            down = langid.loss_and_gradients(m, x, y)[0]
            value[at] = kept
            assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def by_hand(model, data, direction):
    h, out = np.zeros(langid.HIDDEN), np.zeros((len(data), langid.HIDDEN))
    for t in range(len(data)) if direction == 0 else range(len(data) - 1, -1, -1):
        a = model.table[direction, data[t]] + h @ model.inner[direction]
        s = a / (1 + np.abs(a))
        z, c = (s[: langid.HIDDEN] + 1) / 2, s[langid.HIDDEN :]
        out[t] = h = c + z * (h - c)
    return out


@pytest.mark.parametrize(("chunk", "group"), [(4096, 1 << 20), (400, 1 << 20), (400, 10), (4096, 100)])
def test_probabilities_equal_an_unbroken_loop_per_byte(model, monkeypatch, chunk, group):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    monkeypatch.setattr(langid, "GROUP", group)
    monkeypatch.setattr(langid, "LEAD", 1 << 20)
    some = [langid.as_bytes(t) for t in ("lomi ürk rata " * 90, "zzöt vrrn lomi lomi", "ürk", "x", "zzöt rata " * 70)]
    got = [np.zeros((len(d), 2)) for d in some]
    for owner, place, p in model.label(some):
        for i in range(len(some)):
            got[i][place[owner == i]] = p.T[owner == i]
    for data, found in zip(some, got, strict=True):
        logits = by_hand(model, data, 0) @ model.outer[0] + by_hand(model, data, 1) @ model.outer[1] + model.bias
        want = np.exp(logits - logits.max(1, keepdims=True))
        assert np.allclose(found, want / want.sum(1, keepdims=True), atol=1e-4)


def test_states_run_in_equal_an_unbroken_run(sf, monkeypatch):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    m = langid.train([(d["text"], d["lang"]) for d in docs if d["text"] and d["lang"]], steps=100)
    long = max((d["text"] for d in docs), key=len) * 3
    monkeypatch.setattr(langid, "CHUNK", 1 << 30)
    ((_, _, whole),) = m.label([langid.as_bytes(long)])
    monkeypatch.setattr(langid, "CHUNK", 2000)
    got = np.zeros_like(whole)
    for _, place, p in m.label([langid.as_bytes(long)]):
        got[:, place] = p
    assert len(long) > 10_000 and np.allclose(got, whole, atol=1e-4)


def test_positions_pool_to_the_document(model):
    text = texts("aa", 3)[0] * 50 + " " + texts("bb", 1)[0]
    labels = model.label_positions(text)
    lang, score, n, agree = model.documents([text])
    assert len(labels) == len(text.lower().encode()) == n[0]
    assert lang == ["aa"] and labels.count("aa") / len(labels) == pytest.approx(agree[0])
    assert 0.5 < score[0] <= 1


def test_company_does_not_matter(model):
    many = texts("aa", 20) + [None, ""] + texts("bb", 20) + ["lomi " * 3000, "a\x00b"]
    lang, score, n, agree = model.documents(many)
    for i, t in enumerate(many):
        alone = model.documents([t])
        assert (lang[i], n[i]) == (alone[0][0], alone[2][0])
        assert (score[i], agree[i]) == pytest.approx((alone[1][0], alone[3][0]), abs=1e-4)


def test_unknown_and_empty(model):
    assert model.documents([None, "", "12 3!", "\n"])[:2] == (["und"] * 4, [0.0] * 4)
    assert model.documents(["½", "²", "Ⅷ ①", "ª"])[0] == ["und", "und", "und", model.documents(["ª"])[0][0]]
    nobody = langid.train([])
    assert nobody.documents(["lomi"])[0] == ["und"]
    assert langid.train([("lomi", "aa")]).documents(["anything"])[:2] == (["aa"], [1.0])


def test_long_and_tied(model):
    long = "lomi rata " * 100_000
    lang, score, n, _ = model.documents([long, "lomi", "lomi"])
    assert lang[0] == "aa" and n[0] == 1_000_000 and score[1] == score[2]


def test_operator_keeps_columns_and_rows(spark, model):
    docs = spark.createDataFrame([(1, None, "x"), (2, "lomi rata semo lomi", "y"), (2, "lomi rata semo lomi", "y"), (None, "ürk vrrn zzöt ürk", None)], "doc_id long, text string, score string")
    rows = langid.identify(docs, model).collect()
    assert sorted((str(r.doc_id), r.language.lang_pred, str(r.score)) for r in rows) == [("1", "und", "x"), ("2", "aa", "y"), ("2", "aa", "y"), ("None", "bb", "None")]
    assert langid.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_language(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and held
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.93


def test_query_equals_a_loop_per_byte(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = langid.fit(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    rows = {r.doc_id: r for r in op1_language(spark, sf).collect()}
    for r in docs.orderBy("n_chars").limit(12).collect():
        data = langid.as_bytes(r.text)
        logits = by_hand(m, data, 0) @ m.outer[0] + by_hand(m, data, 1) @ m.outer[1] + m.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        pooled = (p / p.sum(1, keepdims=True)).mean(0)
        if any(map(str.isalpha, r.text)):
            assert rows[r.doc_id].lang_pred == m.languages[pooled.argmax()] and rows[r.doc_id].score == pytest.approx(pooled.max(), abs=1e-4)
        else:
            assert (rows[r.doc_id].lang_pred, rows[r.doc_id].score) == ("und", 0.0)
