"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Viterbi decoding labels the lines of a document; the share of its characters in content lines decides on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.text import buffers, mix, split_words

SCHEMA = "doc_id long, n_lines int, content_lines int, line_labels string, content_share double, keep boolean"
#: Rows whose lines are held at a time.
ROWS = 500
LETTER, UPPER, DIGIT, STOP, BANG, PIPE, SYMBOL, BLANK, REST = range(9)


def _classes() -> np.ndarray:
    lut = np.full(256, SYMBOL, np.uint8)
    for chars, kind in (("abcdefghijklmnopqrstuvwxyz", LETTER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (".,;:'\"?-()", STOP), ("!", BANG), ("|", PIPE), (" \t\n\r\f\v", BLANK)):
        lut[[ord(c) for c in chars]] = kind
    lut[0x80:0xC0] = REST  # what follows the first byte of a character
    lut[0xC0:] = LETTER
    return lut


CLASSES = _classes()
#: The features of a line, each in [0, 1].
NAMES = ("bias", "upper", "digits", "stops", "bangs", "pipes", "symbols", "repeats word", "few words differ", "line seen before", "ends a sentence", "under 4 words", "over 40 words", "symbols > 0.05", "pipes > 0.02", "bangs > 0.03", "upper > 0.4", "repeats > 0.3")


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with other than blanks, the characters of each, and offsets of lines by row."""
    data, off = buffers(texts)
    lo, hi = int(off[0]), int(off[-1])
    data, off = data[lo:hi].copy(), off - lo
    cuts = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([off, cuts]))
    starts, ends = bounds[:-1], bounds[1:]
    kind = CLASSES[data]
    kind[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] = UPPER  # accented capitals: 0xC3 counts as a letter besides
    n = np.zeros((len(starts), 9))
    if len(starts):
        for k in range(9):
            n[:, k] = np.add.reduceat(kind == k, starts, dtype=np.int64)
    chars = n[:, :BLANK].sum(1)
    data[(data == 10) | (data == 9) | (data == 13)] = 32
    h, at = split_words(data, bounds if len(bounds) else np.zeros(1, np.int64))
    count = np.diff(at)
    line = np.repeat(np.arange(len(starts)), count)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=len(starts))
    place = np.arange(len(h)) - np.repeat(at[:-1], count)
    order = np.lexsort((h, line))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
    differ = np.bincount(line[order][new], minlength=len(starts))
    whole = np.zeros(len(starts), np.uint64)
    np.add.at(whole, line, mix(h + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    used = (chars > 0) & (count > 0)
    row = np.searchsorted(off, starts, "right") - 1
    # the last character of the line that is no blank, however many blanks follow it
    seen_last = np.maximum.accumulate(np.where(kind == BLANK, -1, np.arange(len(data))))
    last = data[np.maximum(seen_last[np.maximum(ends - 1, 0)], 0)] if len(ends) else data[:0]
    starts, n, chars, count, repeats, differ, whole, row, last = (x[used] for x in (starts, n, chars, count, repeats, differ, whole, row, last))
    pair = np.lexsort((starts, whole, row))
    seen = np.zeros(len(starts), bool)
    seen[pair[1:]] = (whole[pair][1:] == whole[pair][:-1]) & (row[pair][1:] == row[pair][:-1])
    letters = np.maximum(n[:, LETTER] + n[:, UPPER], 1)
    rate = {k: n[:, k] / np.maximum(chars, 1) for k in (DIGIT, STOP, BANG, PIPE, SYMBOL)}
    upper, again = n[:, UPPER] / letters, repeats / np.maximum(count - 1, 1)
    columns = [np.ones(len(starts)), upper, rate[DIGIT], rate[STOP], rate[BANG], rate[PIPE], rate[SYMBOL], again, np.where(count > 5, 1 - differ / np.maximum(count, 1), 0), seen, np.isin(last, [46, 33, 63, 58]), count < 4, count > 40, rate[SYMBOL] > 0.05, rate[PIPE] > 0.02, rate[BANG] > 0.03, upper > 0.4, again > 0.3]
    return np.column_stack(columns).astype(float), chars, np.searchsorted(row, np.arange(len(off)))


@dataclass
class Field:
    """Weights of the field; label 1 is content. emit: by label and feature; move: from label to label; first: by label."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    @staticmethod
    def zero() -> Field:
        return Field(np.zeros((2, len(NAMES))), np.zeros((2, 2)), np.zeros(2))


def steps(at: np.ndarray) -> Iterator[np.ndarray]:
    """For t = 0, 1, ...: the places of the t-th lines of the rows that have one, rows with most lines first."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    for t in range(int(size[0]) if len(size) else 0):
        yield first[: np.searchsorted(-size, -t)] + t


def viterbi(field: Field, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The likeliest labels of all lines; of equal paths, the one with content later on."""
    score = x @ field.emit.T
    back = np.zeros((len(x), 2), np.int8)
    places = list(steps(at))
    for t, now in enumerate(places):
        if not t:
            score[now] += field.first
            continue
        way = score[now - 1][:, :, None] + field.move
        back[now] = (way[:, 1] >= way[:, 0]).astype(np.int8)
        score[now] += way.max(1)
    label = np.zeros(len(x), np.int8)
    for t in range(len(places) - 1, -1, -1):
        now, n = places[t], len(places[t + 1]) if t + 1 < len(places) else 0
        ended = now[n:]
        label[ended] = score[ended, 1] >= score[ended, 0]
        later = now[:n] + 1
        label[now[:n]] = back[later, label[later]]
    return label


def _logsum(v: np.ndarray, axis: int) -> np.ndarray:
    m = v.max(axis, keepdims=True)
    return (m + np.log(np.exp(v - m).sum(axis, keepdims=True))).squeeze(axis)


def gradient(field: Field, x: np.ndarray, at: np.ndarray, label: np.ndarray) -> tuple[float, Field]:
    """Log-likelihood of the labels and its gradient, by the forward-backward recursions."""
    score = x @ field.emit.T
    alpha, beta = score.copy(), np.zeros_like(score)
    places = list(steps(at))
    for t, now in enumerate(places):
        alpha[now] += field.first if not t else _logsum(alpha[now - 1][:, :, None] + field.move, 1)
    for now in reversed(places[1:]):
        beta[now - 1] = _logsum(field.move + (score[now] + beta[now])[:, None, :], 2)
    ends = at[1:][np.diff(at) > 0] - 1
    total = _logsum(alpha[ends], 1)
    z = np.repeat(total, np.diff(at)[np.diff(at) > 0])
    p = np.exp(alpha + beta - z[:, None])
    gold = np.eye(2)[label]
    heads, later = places[0] if places else np.zeros(0, int), np.concatenate(places[1:]) if len(places) > 1 else np.zeros(0, int)
    pair = np.exp(alpha[later - 1][:, :, None] + field.move + (score + beta)[later][:, None, :] - z[later][:, None, None])
    was = np.zeros((2, 2))
    np.add.at(was, (label[later - 1], label[later]), 1)
    like = (score * gold).sum() + (field.move * was).sum() + field.first[label[heads]].sum() - total.sum()
    return float(like), Field((gold - p).T @ x, was - pair.sum(0), (gold - p)[heads].sum(0))


def climb(field: Field, x: np.ndarray, at: np.ndarray, label: np.ndarray, rounds: int, moves: bool, ridge: float = 1e-3) -> Field:
    """Adam on the penalised mean log-likelihood."""
    keys = ("emit", "move", "first") if moves else ("emit",)
    m, v = Field.zero(), Field.zero()
    for i in range(1, rounds + 1):
        _, g = gradient(field, x, at, label)
        for k in keys:
            d = getattr(g, k) / max(1, len(x)) - ridge * getattr(field, k)
            setattr(m, k, 0.9 * getattr(m, k) + 0.1 * d)
            setattr(v, k, 0.99 * getattr(v, k) + 0.01 * d * d)
            step = getattr(m, k) / (1 - 0.9**i) / (np.sqrt(getattr(v, k) / (1 - 0.99**i)) + 1e-9)
            setattr(field, k, getattr(field, k) + 0.1 * step)
    return field


def fit(texts: list[str | None], good: list[int], rounds: int = 80) -> Field:
    """A field from documents labelled as a whole.

    Lines of good documents are content. A first fit without transitions tells which lines of bad documents look like
    content all the same, if each is under a third of its document; a second fit, of the whole field, is to those
    labels. Without labels of both kinds, all weights are 0 but for a bias to content, so that nothing is rejected.
    """
    field = Field.zero()
    x, chars, at = lines(pa.array(texts, pa.string()))
    label = np.repeat(np.asarray(good, np.int64), np.diff(at)) if len(texts) else np.zeros(0, np.int64)
    if len(np.unique(label)) < 2:
        field.emit[1, 0] = 1.0
        return field
    field = climb(field, x, at, label, rounds, False)
    odds = x @ (field.emit[1] - field.emit[0])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    minor = chars < np.bincount(row, chars)[row] / 3
    label = np.where((label == 0) & (odds > 2.0) & minor, 1, label)
    return climb(field, x, at, label, rounds, True)


def training(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[str], list[int]]:
    """Texts and quality of at most ``most`` labelled documents, those whose ids hash lowest."""
    ids = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "quality").filter("text is not null").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [int(r["quality"] > 0) for r in rows]


def judge(field: Field, texts: pa.Array, min_share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels of all lines, their offsets by row, and by row the share of content and the verdict."""
    x, chars, at = lines(texts)
    label = viterbi(field, x, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total, inside = (np.bincount(row, w, minlength=len(at) - 1) for w in (chars, chars * label))
    share = np.round(inside / np.maximum(total, 1), 6)
    return label, at, share, share >= min_share


def filter_docs(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``label_lines`` keeps, with all their columns; nothing is joined or shuffled.

    Cases are those of ``label_lines``; columns are neither added nor replaced, whatever their names.
    """
    if "text" not in docs.columns:
        raise ValueError("no column text")
    place = docs.columns.index("text")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield part.filter(pa.array(judge(field, part.column(place), min_share)[3]))

    return docs.mapInArrow(one, docs.schema)


def label_lines(docs: DataFrame, field: Field, min_share: float = 0.5) -> DataFrame:
    """For each row: its lines, those that are content, a letter a line (C content, B boilerplate), the share, the verdict.

    Lines of blanks only aren't counted. content_share: of the bytes other than blanks, those in content lines;
    keep: the share is at least ``min_share``.

    Null text, empty text and text of blanks: no lines, share 0, not kept. Null id: as other rows. Repeated rows: a row
    each. No rows: none. Extra columns aren't passed on. Long texts: whole, in NumPy.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                label, at, share, keep = judge(field, part.column(1), min_share)
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                letters = np.where(label == 1, b"C", b"B").tobytes().decode()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int32()), pa.array(np.bincount(row, label, minlength=len(n)).astype(np.int32)), pa.array([letters[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], pa.string()), pa.array(share), pa.array(keep)],
                    ["doc_id", "n_lines", "content_lines", "line_labels", "content_share", "keep"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(one, SCHEMA)
