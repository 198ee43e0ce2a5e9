"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams are scaled by the log-count ratios of the two classes; a linear model of hinge loss is fitted
to them by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.text import U, mix, ngrams, words

#: Indicators are told apart by so many bits of their hashes.
BITS = 20
N = 2
ROWS = 500
#: What stands for a word that is the one before, or the one before that, again.
AGAIN, AGAIN2 = U(0x1234567890ABCDEF), U(0xFEDCBA0987654321)


def marked(text: Column) -> Column:
    """Words and runs of other signs, case kept, with single spaces between."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\p{L}\p{M}\p{N}\s]+)", " $1 ")
    return F.trim(F.regexp_replace(apart, r"\s+", " "))


def indicators(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different indicators of each row, by number, of all n-grams of 1 to n words, and the offsets of rows."""
    h, at = words(texts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    h1 = h.copy()
    if len(h) > 2:
        h1[2:][(h[2:] == h[:-2]) & (row[2:] == row[:-2])] = AGAIN2
        h1[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])] = AGAIN
    parts = []
    for k in range(1, n + 1):
        g, o = ngrams(h1, at, k)
        of = np.repeat(np.arange(len(o) - 1), np.diff(o)).astype(U)
        parts.append((of << U(BITS)) | (mix(g + U(k)) >> U(64 - BITS)))
    both = np.unique(np.concatenate(parts))
    return (both & U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(both, np.arange(len(at)).astype(U) << U(BITS))


@dataclass
class Model:
    """weights: of each indicator, with the ratio in it. scaled: whether sums are divided by the root of the number of
    indicators, so that long texts aren't surer for their length. n: the longest n-grams."""

    weights: np.ndarray
    bias: float
    scaled: bool = True
    n: int = N

    def scores(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Margins of texts given as ``indicators``."""
        total = np.concatenate([[0.0], np.cumsum(self.weights[f].astype(float))])
        n = np.diff(at)
        return (total[at[1:]] - total[at[:-1]]) / (np.sqrt(np.maximum(n, 1)) if self.scaled else 1.0) + self.bias


def fit(texts: Sequence[str], label: Sequence[int], scaled: bool = True, n: int = N, cost: float = 1.0, rounds: int = 15, smooth: float = 1.0, seed: int = 0) -> Model:
    """A model from texts in the form of ``marked`` and labels 0 and 1.

    Ratios: logs of the smoothed shares of an indicator in the documents of a class. Dual coordinate descent on the
    hinge loss, with costs by class in inverse proportion to its size. With labels of one kind only, or none, every
    text has that label's sign, without a label the positive one.
    """
    y = np.where(np.asarray(label, np.int64) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), float(y[0]) if len(y) else 1.0, scaled, n)
    f, at = indicators(pa.array(texts, pa.string()), n)
    doc = np.repeat(np.arange(len(y)), np.diff(at))
    p, q = (smooth + np.bincount(f[y[doc] == s], minlength=1 << BITS) for s in (1.0, -1.0))
    seen = (p + q) > 2 * smooth
    ratio = np.where(seen, np.log(p / p[seen].sum()) - np.log(q / q[seen].sum()), 0.0)
    value = ratio[f] / (np.sqrt(np.maximum(np.diff(at), 1))[doc] if scaled else 1.0)
    most = np.where(y > 0, cost * len(y) / (2 * (y > 0).sum()), cost * len(y) / (2 * (y < 0).sum()))
    norm = np.bincount(doc, value * value, minlength=len(y)) + 1.0
    w, bias, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            j, v = f[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
            slope = y[i] * (w[j] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[j] += step * v
                bias += step
                alpha[i] = new
    return Model((w * ratio).astype(np.float32), float(bias), scaled, n)


def training(docs: DataFrame, labels: DataFrame, most: int) -> list[tuple[str, int | None, int | None]]:
    """(text, quality, toxic) of at most ``most`` labelled documents, those whose ids hash lowest."""
    ids = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", marked(F.col("text")).alias("text")).join(F.broadcast(ids), "doc_id").filter("text <> ''").collect()
    return sorted(((r["text"], r["quality"], r["toxic"]) for r in rows), key=repr)


def fit_both(rows: Sequence[tuple[str, int | None, int | None]]) -> tuple[Model, Model]:
    """The model of quality, and that of toxic texts; a null label leaves its row out of that fit.

    A few words make a text toxic, however long it is: that model is of words and isn't scaled.
    """
    good = [(t, q) for t, q, _ in rows if q is not None]
    bad = [(t, x) for t, _, x in rows if x is not None] or [("", 0)]
    return fit([t for t, _ in good], [q for _, q in good]), fit([t for t, _ in bad], [x for _, x in bad], scaled=False, n=1, cost=0.01)


SCHEMA = "doc_id long, quality_margin double, toxic_margin double, keep boolean"


def classify(docs: DataFrame, quality: Model, toxic: Model) -> DataFrame:
    """For each row the margins of the two models and whether it is to be kept: of good quality and not toxic.

    Null, empty and blank texts have no indicator: their margins are the models' biases, and they aren't kept. Null id
    and repeated rows: a row each. No rows: none. Extra columns aren't passed on. Long texts: whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((quality, toxic))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                good, bad = (m.scores(*indicators(part.column(1), m.n)) for m in shared.value)
                some = np.array([bool(t) for t in part.column(1).to_pylist()], bool)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(good, 6)), pa.array(np.round(bad, 6)), pa.array((good >= 0) & (bad < 0) & some)], ["doc_id", "quality_margin", "toxic_margin", "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), marked(F.col("text")).alias("text")).mapInArrow(one, SCHEMA)
