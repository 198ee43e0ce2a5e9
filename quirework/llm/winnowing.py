"""Benchmark decontamination by winnowing: the minimum k-gram hash of each window, on both sides, joined and extended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import fresh, plain
from quirework.llm.text import ngrams, words

SPANS = "doc_id long, item_id long, doc_start int, item_start int, n_words int"
#: Grams of K words, windows of W grams: every shared span of W + K - 1 = 12 words or more has a fingerprint in common.
K, W = 8, 5
ROWS = 500


def winnow(g: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every w consecutive ones within a row, the rightmost of equal ones.

    A row of fewer hashes than w is one window.
    """
    n = np.diff(at)
    short = np.concatenate([np.arange(a, b) for a, b in zip(at[:-1][(n > 0) & (n < w)], at[1:][(n > 0) & (n < w)], strict=True)] or [np.zeros(0, np.int64)])
    best = np.zeros(0, np.int64)
    if len(g) >= w:
        best = np.arange(len(g) - w + 1)
        ok = np.repeat(n >= w, n)[: len(best)]
        last = at[1:][n >= w]
        for i in range(1, w):
            ok[(last - i)[(last - i) < len(ok)]] = False
        best = best[ok]
        first = best.copy()
        for i in range(1, w):
            best = np.where(g[first + i] <= g[best], first + i, best)
    if len(short):
        row = np.searchsorted(at, short, "right") - 1
        order = np.lexsort((-short, g[short], row))
        lead = np.ones(len(order), bool)
        lead[1:] = row[order][1:] != row[order][:-1]
        best = np.concatenate([best, short[order][lead]])
    return np.unique(best)


def extend(doc: np.ndarray, item: np.ndarray, anchors: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The longest runs of equal words through the anchors (place in doc, place in item): (doc, item, words), each once."""
    out, done = [], {}
    for p, q in anchors[np.lexsort((anchors[:, 0], anchors[:, 0] - anchors[:, 1]))].tolist():
        if p < done.get(p - q, 0) or doc[p] != item[q]:
            continue
        left = min(p, q)
        same = doc[p - left : p] == item[q - left : q]
        back = left - (int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0)
        right = min(len(doc) - p, len(item) - q)
        same = doc[p : p + right] == item[q : q + right]
        ahead = right if same.all() else int(np.argmin(same))
        done[p - q] = p + ahead
        if back + ahead >= least:
            out.append((p - back, q - back, back + ahead))
    return out


def fingerprints(h: np.ndarray, at: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, row, place of its first word in the row) of texts given as word hashes."""
    g, o = ngrams(h, at, k)
    place = winnow(g, o, w)
    row = np.searchsorted(o, place, "right") - 1
    return g[place], row, place - o[row]


def gaps(f: np.ndarray, row: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """How many words before each fingerprint its row has the same one, if at most k, else 0.

    If both sides of an anchor have the same one as many words before, there is an anchor there too, and the words up to
    here are equal: the one before is enough. So a word or a phrase that goes on and on makes few anchors.
    """
    order = np.lexsort((place, f, row))
    ahead = np.diff(place[order])
    near = (ahead <= k) & (f[order][1:] == f[order][:-1]) & (row[order][1:] == row[order][:-1])
    out = np.zeros(len(f), np.int32)
    out[order[1:]] = np.where(near, ahead, 0)
    return out


class Index:
    """The fingerprints of a benchmark, sorted, with the words of its items."""

    def __init__(self, ids: list[int], texts: list[str], k: int, w: int) -> None:
        self.k, self.w, self.ids = k, w, ids
        self.h, self.at = words(pa.array(texts, pa.string()))
        f, row, place = fingerprints(self.h, self.at, k, w)
        gap = gaps(f, row, place, k)
        order = np.lexsort((gap, f))
        self.row, self.place, self.gap = row[order], place[order], gap[order]
        # where each fingerprint begins and ends, and each fingerprint with a gap
        self.f, self.start = np.unique(f[order], return_index=True)
        self.end = np.append(self.start[1:], len(f))
        self.code = np.repeat(np.arange(len(self.f)), self.end - self.start) * (k + 1) + self.gap

    def anchors(self, f: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): fingerprints of a text and of the index that are equal, less those that follow from one before."""
        at = np.searchsorted(self.f, f)
        i = np.flatnonzero(self.f[np.minimum(at, len(self.f) - 1)] == f) if len(self.f) else np.zeros(0, np.int64)
        code = at[i] * (self.k + 1) + gap[i]
        lo, hi = (np.where(gap[i] > 0, np.searchsorted(self.code, code, side), self.end[at[i]]) for side in ("left", "right"))
        out = []
        for a, b in ((self.start[at[i]], lo), (hi, self.end[at[i]])):
            n = b - a
            out.append((np.repeat(i, n), np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def spans(self, texts: pa.Array, least: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, place in the text, place in the item, words) of every shared span, over whole texts."""
        h, at = words(texts)
        f, row, place = fingerprints(h, at, self.k, self.w)
        i, j = self.anchors(f, gaps(f, row, place, self.k))
        order = np.lexsort((self.row[j], row[i]))
        i, j = i[order], j[order]
        cut = np.flatnonzero((np.diff(row[i]) != 0) | (np.diff(self.row[j]) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(i)], strict=True) if len(i) else ():
            r, q = int(row[i[a]]), int(self.row[j[a]])
            anchors = np.column_stack([place[i[a:b]], self.place[j[a:b]]])
            for p, s, n in extend(h[at[r] : at[r + 1]], self.h[self.at[q] : self.at[q + 1]], anchors, least):
                yield r, self.ids[q], p, s, n


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("text")).filter("item_id is not null and text is not null and text <> ''").distinct()


def _index(items: DataFrame, k: int, w: int, most_words: int) -> Index | None:
    """The whole benchmark as an index if its words, counted first, are at most ``most_words``; else None."""
    n = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    if n > most_words:
        return None
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    return Index([r[0] for r in rows], [r[1] for r in rows], k, w)


def _joined(docs: DataFrame, items: DataFrame, k: int, w: int, least: int) -> DataFrame:
    """(md5 of the text, item, places, words) of all shared spans, by a join of all fingerprints."""
    texts = docs.select(plain(F.col("text")).alias("text")).filter("text is not null and text <> ''").distinct()
    texts = texts.select(F.unhex(F.md5("text")).alias("key"), "text")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                f, row, place = fingerprints(*words(part.column(1)), k, w)
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), part.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(gaps(f, row, place, k))], ["f", "id", "place", "gap"])

    left = texts.mapInArrow(emit, "f long, id binary, place int, gap int")
    right = items.select("item_id", "text").mapInArrow(emit, "f long, id long, place int, gap int").select("f", F.col("id").alias("item_id"), F.col("place").alias("at_item"), F.col("gap").alias("item_gap"))
    pairs = left.join(right, "f").filter("gap = 0 or gap <> item_gap").groupBy("id", "item_id").agg(F.collect_list(F.struct("place", "at_item")).alias("anchors"))
    full = pairs.join(texts, pairs["id"] == texts["key"]).drop("key").join(items.withColumnRenamed("text", "item"), "item_id")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (h, at), (g, to) = words(b.column(2)), words(b.column(3))
            out = []
            for r in range(b.num_rows):
                anchors = np.array([(x["place"], x["at_item"]) for x in b.column(4)[r].as_py()])
                out += [(b.column(0)[r].as_py(), b.column(1)[r].as_py(), *x) for x in extend(h[at[r] : at[r + 1]], g[to[r] : to[r + 1]], anchors, least)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["key", "item_id", "doc_start", "item_start", "n_words"])

    return full.select("id", "item_id", "text", "item", "anchors").mapInArrow(grow, "key binary, item_id long, doc_start int, item_start int, n_words int")


def shared_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, index_words: int = 5_000_000) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words): every longest run of words that a document and an item share.

    Words are runs of letters, marks and digits in lower case; places count words from 0. All runs of w + k - 1 words
    or more are found, and no shorter ones are given. A benchmark of up to ``index_words`` words, counted first, goes to
    the executors as an index and documents aren't shuffled; beyond, fingerprints of both sides are joined.

    Null id of a document or an item: not reported. Null, empty and short texts share nothing. Long texts: whole; a word
    or phrase that goes on and on takes time in proportion to its spans. Ties between equal hashes: the rightmost. Repeated
    rows: reported once. Empty tables: no rows. Extra columns aren't passed on.
    """
    items, least = _items(benchmark), w + k - 1
    index = _index(items, k, w, index_words)
    if index is None:
        found = _joined(docs, items, k, w, least)
        keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(plain(F.col("text")))).alias("key"))
        return keys.join(found, "key").filter("doc_id is not null").select("doc_id", "item_id", "doc_start", "item_start", "n_words").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                cols = list(zip(*shared.value.spans(part.column(1), least), strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True))], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''").mapInArrow(one, SPANS).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, w: int = W, index_words: int = 5_000_000) -> DataFrame:
    """The rows of ``docs`` that share no span of w + k - 1 words with the benchmark, with all their columns.

    Rows are judged by their text, so those without an id are too; null and empty texts stay. Long texts: whole. Repeated
    rows: each is judged. No documents: no rows; no benchmark: all rows. Columns are neither added nor replaced, whatever their names.
    """
    items, least = _items(benchmark), w + k - 1
    index = _index(items, k, w, index_words)
    name = fresh(docs, "winnow_text")
    if index is None:
        found = _joined(docs, items, k, w, least).select("key").distinct().withColumnRenamed("key", name)
        return docs.join(found, F.unhex(F.md5(plain(docs["text"]))) == found[name], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                keep = np.ones(part.num_rows, bool)
                keep[[s[0] for s in shared.value.spans(part.column(part.num_columns - 1), least)]] = False
                kept = part.filter(pa.array(keep))
                yield kept.select(kept.schema.names[:-1]) if len(set(kept.schema.names)) == kept.num_columns else pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(one, docs.schema)
