import zlib

import numpy as np
from packlens.llm import language_id as L

from .conftest import make


def test_held_out_accuracy(docs):
    out = {r.doc_id: r for r in L.predict(docs, L.train(docs)).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(out) == docs.count() and all(out[r.doc_id].held_out for r in held)
    assert sum(out[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())


def grams(t):
    t = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_is_the_number_of_common_grams():
    for x, y in (("Abc abd", "ABD"), ("ÉCOLE! 12 école", "écol"), ("नमस्ते दुनिया", "दुनिया"), ("aⅧb ½x", "x b")):
        a, b = L.presence(x, 20, 3), L.presence(y, 20, 3)
        assert len(np.intersect1d(a, b)) == len(grams(x) & grams(y))
        assert len(a) == len(grams(x))


def test_scores_against_kernel_ridge_regression_on_sets(docs):
    """The same model with kernels counted on sets of n-grams, and all texts as landmarks."""
    rows = [r for r in docs.orderBy("doc_id").collect() if L.has_letter(r.text) and len(r.text) < 3000][:60]
    texts, langs = [r.text for r in rows[:40]], [r.lang for r in rows[:40]]
    m = L.fit(texts, langs, landmarks=40, bits=22)
    sets = [grams(t) for t in texts]
    kernel = lambda x, y: len(x & y) / (len(x) * len(y)) ** 0.5
    k = np.array([[kernel(x, y) for y in sets] for x in sets])
    w = np.diag([1 / langs.count(y) for y in langs])
    y = np.array([[1.0 if lab == n else -1.0 for n in m.langs] for lab in langs])
    alpha = np.linalg.solve(w @ k + 1e-3 * np.eye(len(k)), w @ y)
    want = np.array([[kernel(grams(r.text), s) for s in sets] for r in rows[40:]]) @ alpha
    got = m.scores([r.text for r in rows[40:]])
    assert np.abs(got - want).max() < 0.03 and (got.argmax(1) == want.argmax(1)).all()


def test_no_letters(spark, docs):
    texts = ["½ ² ① Ⅷ", "12 !! 34 _", "", None, "½ a", "ª", "語"]
    rows = L.predict(make(spark, texts), L.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in rows] == [not any(map(str.isalpha, t or "")) for t in texts]


def test_sample_is_bounded_and_learns_rare_languages(spark):
    long = "x" * 30_000
    rows = [(i, long if i % 2 else f"hello world number {i}", "en") for i in range(3000)] + [(5000 + i, f"{'12 ' * i}", "xx") for i in range(300)]
    rows += [(6000 + i, f"guten tag nummer {i}" if i > 280 else "12", "de") for i in range(300)] + [(7000 + i, f"salut {i}", f"l{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.training_sample(df, 100, 4096, 20_000, "doc_id", "text", "lang")
    per = got.groupby("lang").size()
    assert per["en"] == 100 and per["de"] == sum(zlib.crc32(str(6000 + i).encode()) % 3 != 1 for i in range(281, 300)) and "xx" not in per
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in got["id"])
    few = L.training_sample(df, 100, 8, 20_000, "doc_id", "text", "lang")
    assert len(few) <= 8 and {"en", "de"} <= set(few["lang"])
    assert {"en", "de"} <= set(L.train(df, per_lang=100).langs)


def test_odd_and_empty(odd_docs, no_docs, docs):
    m = L.train(docs)
    rows = L.predict(odd_docs, m).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {3, 4, 7, 10} and all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert L.predict(no_docs, m).count() == 0 and {r.lang_pred for r in L.predict(docs, L.train(no_docs)).collect()} == {"und"}
    left = L.drop_undetermined(odd_docs.withColumnRenamed("n", "gone_0"))
    assert left.columns == [c if c != "n" else "gone_0" for c in odd_docs.columns] and left.count() == odd_docs.count() - 4
