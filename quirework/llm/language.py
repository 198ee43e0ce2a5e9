"""Language identification by a string kernel: presence of blended character n-grams, Nyström landmarks, ridge regression.

k(x, y) is the number of different n-grams, of all lengths from ``LEAST`` to ``MOST``, that both texts have, divided by
the root of k(x, x) k(y, y). Texts are mapped to their kernel values with a few landmark texts, whitened by the inverse
root of the landmarks' own kernel matrix; one ridge regression for each language against the rest scores them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1, 3
#: An n-gram, of whatever characters, is one of 2^BITS places by its hash.
BITS = 17
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
BATCH = 64
SCHEMA = "doc_id long, lang string, score double, margin double"


def letters(text: Column) -> Column:
    """Lower-case letters and marks; whatever lies between is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))


def presence(texts: list[str], least: int, most: int) -> np.ndarray:
    """A row for each text and a column for each place of an n-gram: whether the text, all of it and a space on either
    side, has it."""
    size = np.array([len(t) + 2 for t in texts], np.int64)
    x = np.frombuffer(("".join(f" {t} " for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros((len(texts), 1 << BITS), bool)
    row = np.repeat(np.arange(len(texts)), size)
    code = np.zeros(len(x), np.uint64)
    for n in range(1, most + 1):
        # every n-gram one longer: characters, n-grams before, and n in one sum
        code = (code[: len(x) - n + 1] + x[n - 1 :]) * FACTORS[n % 4] + np.uint64(n)
        if n >= least:
            inside = row[: len(code)] == row[n - 1 :]
            spread = (code ^ (code >> np.uint64(31))) * FACTORS[0]
            out.reshape(-1)[((row[: len(code)] << BITS) + (spread >> np.uint64(64 - BITS)).astype(np.int64))[inside]] = True
    return out


class Kernel:
    """Landmarks and regressions. ``classes``: the languages; without any, all texts are undetermined ('und')."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = 128, ridge: float = 1e-2, least: int = LEAST, most: int = MOST) -> None:
        self.least, self.most = least, most
        texts, langs = [t for t in texts if t], [g for t, g in zip(texts, langs, strict=True) if t]
        self.classes = sorted(set(langs))
        if not self.classes:
            return
        # as many landmarks of each language, in the order given
        turn, order = {}, []
        for i, g in enumerate(langs):
            turn[g] = turn.get(g, 0) + 1
            order.append((turn[g], i))
        picked = sorted(i for _, i in sorted(order)[:landmarks])
        marks = presence([texts[i] for i in picked], least, most)
        self.used = np.flatnonzero(marks.any(0))
        own = marks.sum(1)
        self.marks = (marks[:, self.used] / np.sqrt(own)[:, None]).astype(np.float32)
        value, vector = np.linalg.eigh((self.marks @ self.marks.T).astype(float))
        ok = value > 1e-6 * value.max()
        self.white = vector[:, ok] / np.sqrt(value[ok])
        z = np.concatenate([self.features(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)])
        y = np.where(np.array(langs)[:, None] == np.array(self.classes)[None, :], 1.0, -1.0)
        z = np.hstack([z, np.ones((len(z), 1))])
        # every language weighs the same, however many of its texts there are
        weight = 1.0 / np.array([langs.count(g) for g in langs])[:, None] / len(self.classes)
        solved = np.linalg.solve(z.T @ (z * weight) + ridge / len(z) * np.eye(z.shape[1]), z.T @ (y * weight))
        self.weights, self.bias = (self.white @ solved[:-1]).astype(np.float32), solved[-1]

    def similar(self, texts: list[str]) -> np.ndarray:
        """Kernel values with the landmarks: one matrix product for the batch."""
        seen = presence(texts, self.least, self.most)
        own = np.maximum(np.count_nonzero(seen, axis=1), 1)
        return (seen[:, self.used].astype(np.float32) @ self.marks.T) / np.sqrt(own)[:, None]

    def features(self, texts: list[str]) -> np.ndarray:
        return self.similar(texts) @ self.white

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.similar(texts) @ self.weights + self.bias


def training(docs: DataFrame, most: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``most`` labelled documents: the lowest hashes of texts, whatever their order."""
    own = docs.filter("lang is not null and text is not null")
    h = own.select(F.xxhash64("text").alias("h"))
    # so low that about 8 times as many rows pass: few are shuffled, unless most texts are repeated ones
    share = min(1.0, 8 * most / max(1, own.count()))
    low: list[int] = []
    for cut in (share, 1.0):
        if len(low) < most:
            low = [r["h"] for r in h.filter(F.col("h") <= min(2**63 - 1, int(cut * 2**64) - 2**63)).distinct().orderBy("h").limit(most).collect()]
    top = low[-1] if low else None
    if top is None:
        return [], []
    d = docs.filter((F.xxhash64("text") <= F.lit(top)) & F.col("lang").isNotNull()).select(letters(F.col("text")).alias("text"), F.col("lang").cast("string").alias("lang")).filter("text <> ''").distinct()
    rows = sorted(((r["text"], r["lang"]) for r in d.collect()), key=lambda r: (zlib.crc32(r[0].encode("utf-8", "surrogatepass")), r))
    return [r[0] for r in rows], [r[1] for r in rows]


def identify(docs: DataFrame, kernel: Kernel) -> DataFrame:
    """For each row the likeliest language, its score, and the margin over the next.

    Texts without a letter, among them null and empty ones, are 'und' with score and margin 0, as is every text if the
    kernel has no class. With one class, the margin is the score. Ties: the language first in the alphabet. Null id and
    repeated rows: a row each. No rows: none. Extra columns aren't passed on. Long texts: whole.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            lang, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if t] if kernel.classes else []
            for i in range(0, len(real), BATCH):
                part = real[i : i + BATCH]
                s = kernel.scores([texts[j] for j in part]).astype(float)
                best = s.argmax(1)
                first = s[np.arange(len(part)), best]
                rest = s.copy()
                rest[np.arange(len(part)), best] = -np.inf
                score[part] = first
                margin[part] = first - rest.max(1) if s.shape[1] > 1 else first
                for j, k in zip(part, best.tolist(), strict=True):
                    lang[j] = kernel.classes[k]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.round(score, 4)), pa.array(np.round(margin, 4))], ["doc_id", "lang", "score", "margin"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), letters(F.col("text")).alias("text")).mapInArrow(one, SCHEMA)
