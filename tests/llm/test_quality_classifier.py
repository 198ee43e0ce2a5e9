import random

import numpy as np
import pyarrow as pa

from quirework.llm.quality_classifier import BITS, classify, fit, fit_both, indicators, marked, training
from tests.llm.helpers import DOCS, HARD, docs


def corpus(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        quality, toxic = int(r.random() < 0.7), int(r.random() < 0.2)
        words = [r.choice("abcdefgh") + r.choice("aeiou") for _ in range(r.randint(10, 60))]
        if not quality:
            words = [w + " $$$" if r.random() < 0.5 else w for w in words]
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["idiot", "trash"]))
        rows.append((" ".join(words), quality, toxic))
    return rows


def test_indicators_are_sets_of_ngrams():
    texts = ["a b c", "", "x y x", "z z z z", "a b"]
    f, at = indicators(pa.array(texts))
    got = [set(f[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert [len(s) for s in got] == [5, 0, 5, 4, 3] and len(got[0] & got[4]) == 3
    assert all(0 <= x < 1 << BITS for s in got for x in s)


def test_dual_descent_reaches_the_optimum():
    """The primal objective is near that of a long subgradient descent on the same features."""
    rows = corpus(1, 80)
    texts, y = [r[0] for r in rows], np.array([1.0 if r[1] else -1.0 for r in rows])
    f, at = indicators(pa.array(texts))
    p, q = (1 + np.bincount(np.concatenate([f[at[i] : at[i + 1]] for i in np.flatnonzero(y == s)]), minlength=1 << BITS) for s in (1, -1))
    seen = p + q > 2
    ratio = np.where(seen, np.log(p / p[seen].sum()) - np.log(q / q[seen].sum()), 0)
    used = np.flatnonzero(seen)
    x = np.zeros((len(y), len(used) + 1))
    for i in range(len(y)):
        j = f[at[i] : at[i + 1]]
        x[i, np.searchsorted(used, j)] = ratio[j] / np.sqrt(len(j))
    x[:, -1] = 1
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    value = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, best = np.zeros(x.shape[1]), np.inf
    for t in range(1, 6000):
        w = w - (1 / (t + 20)) * (w - x.T @ (cost * y * (y * (x @ w) < 1)))
        best = min(best, value(w))
    m = fit(texts, [r[1] for r in rows], rounds=200)
    own = np.append(np.divide(m.weights[used], ratio[used], out=np.zeros(len(used)), where=ratio[used] != 0), m.bias)
    assert value(own) <= best * 1.02 + 1e-3


def test_held_out_accuracy(spark):
    rows = corpus(2, 600)
    quality, toxic = fit_both(rows[:400])
    got = {r["doc_id"]: r for r in classify(docs(spark, [r[0] for r in rows[400:]]), quality, toxic).collect()}
    assert np.mean([(got[i]["quality_margin"] >= 0) == bool(r[1]) for i, r in enumerate(rows[400:])]) > 0.97
    assert np.mean([(got[i]["toxic_margin"] >= 0) == bool(r[2]) for i, r in enumerate(rows[400:])]) > 0.95
    assert all(got[i]["keep"] == (got[i]["quality_margin"] >= 0 > got[i]["toxic_margin"]) for i in range(200))


def test_marked(spark):
    d = docs(spark, ["Ab,cd!! x\n y", None, " ", "é_1 $$a"])
    assert [r[0] for r in d.select(marked(d["text"])).collect()] == ["Ab , cd !! x y", "", "", "é _ 1 $$ a"]


def test_hard_rows_and_training(spark):
    d = docs(spark, HARD, ids=[0, None, 2, 3, 3, 4, 5, 6, 7, 8]).selectExpr("*", "1 quality", "2 toxic", "3 keep")
    quality, toxic = fit_both(corpus(3, 100))
    out = classify(d, quality, toxic).collect()
    assert len(out) == len(HARD) and not any(r["keep"] for r in out if r["doc_id"] in (0, None, 2))
    assert classify(spark.createDataFrame([], DOCS), quality, toxic).collect() == []
    none = fit_both([])
    assert all(r["keep"] == (r["doc_id"] not in (0, None, 2)) for r in classify(d, *none).collect())
    assert fit(["a"], [0]).bias == -1.0 and fit([], []).bias == 1.0
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (8, None, 1), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert training(d.drop("quality", "toxic", "keep"), labels, 10) == [("a", None, 1), ("one two three four", 0, 1), ("one two three four", 0, 1)]
    assert len(training(d, labels, 10)) == 3
