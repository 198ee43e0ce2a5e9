import random

import numpy as np

from quirework.llm.language import Kernel, identify, presence, training
from tests.llm.helpers import DOCS, HARD, docs

WORDS = {
    "en": "the of and that house water thing should where light morning".split(),
    "de": "der die und nicht haus wasser schön über straße möchte früh".split(),
    "fr": "le la et pas maison eau être où lumière français déjà".split(),
}


def corpus(seed, n):
    r = random.Random(seed)
    langs = [r.choice(sorted(WORDS)) for _ in range(n)]
    return [" ".join(r.choices(WORDS[g], k=r.randint(4, 60))) for g in langs], langs


def test_kernel_is_that_of_sets():
    texts, langs = corpus(1, 40)
    k = Kernel(texts, langs, landmarks=8)

    def grams(t):
        return {t[i : i + n] for t in [f" {t} "] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    marks = [texts[i] for i in sorted(i for _, i in sorted((langs[:i + 1].count(g), i) for i, g in enumerate(langs))[:8])]
    new = ["the maison über", "xyz ж 漢", "a"]
    want = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in marks] for a in new]
    assert np.allclose(k.similar(new), want, atol=5e-3)  # a few n-grams may share a place
    assert presence(["ab", ""], 1, 3).sum(1).tolist() == [len(grams("ab")), len(grams(""))]


def test_rarer_scripts_are_told_apart():
    """Alphabets that have no character in common, beside a majority of another script."""
    r = random.Random(9)
    word = lambda a, n: "".join(chr(a + r.randint(0, n)) for _ in range(4))
    make = {"en": lambda: r.choice(WORDS["en"]), "han": lambda: word(0x4E00, 900), "hangul": lambda: word(0xAC00, 900), "amh": lambda: word(0x1200, 60)}
    langs = ["en"] * 120 + ["han", "hangul", "amh"] * 20
    texts = [" ".join(make[g]() for _ in range(30)) for g in langs]
    k = Kernel(texts, langs, landmarks=40)
    new = [g for g in ("han", "hangul", "amh", "en") for _ in range(20)]
    got = k.scores([" ".join(make[g]() for _ in range(30)) for g in new]).argmax(1)
    assert [k.classes[i] for i in got] == new


def test_landmarks_span_the_training_kernel():
    """With every text a landmark, the features give back the kernel matrix."""
    texts, langs = corpus(2, 12)
    k = Kernel(texts, langs, landmarks=12)
    z, own = k.features(texts), k.similar(texts)
    assert np.allclose(z @ z.T, own, atol=1e-3)


def test_held_out_accuracy(spark):
    texts, langs = corpus(3, 400)
    k = Kernel(texts[:200], langs[:200], landmarks=30)
    got = {r["doc_id"]: r["lang"] for r in identify(docs(spark, texts[200:]), k).collect()}
    assert np.mean([got[i] == g for i, g in enumerate(langs[200:])]) > 0.98


def test_hard_rows_and_training(spark):
    texts, langs = corpus(4, 60)
    d = docs(spark, HARD, ids=[0, None, 2, 3, 3, 4, 5, 6, 7, 8]).selectExpr("*", "1 score", "2 margin", "3 h")
    k = Kernel(texts, langs, landmarks=200)
    out = identify(d, k).collect()
    assert len(out) == len(HARD)
    assert {(r["doc_id"], r["lang"], r["score"], r["margin"]) for r in out if r["doc_id"] in (0, None, 2, 7)} == {(i, "und", 0.0, 0.0) for i in (0, None, 2, 7)}
    assert len({(r["lang"], r["score"]) for r in out if r["doc_id"] == 3}) == 1
    assert identify(spark.createDataFrame([], DOCS), k).collect() == []
    assert {r["lang"] for r in identify(d, Kernel([], [])).collect()} == {"und"}
    assert {r["lang"] for r in identify(d, Kernel(["abc", "abd"], ["en", "en"])).filter("doc_id = 3").collect()} == {"en"}
    few = training(d, 3)
    assert len(few[0]) == len(few[1]) <= 3 and training(spark.createDataFrame([], DOCS), 5) == ([], [])
    assert len(training(d, 1000)[0]) == 5  # distinct texts with letters
