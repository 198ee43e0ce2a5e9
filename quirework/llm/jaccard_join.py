"""N-gram Jaccard join by parity sketches: pigeonhole on their segments within size bands, then verification.

The parity sketch of a set has a bit for each hash value, set if an odd number of tokens has it; the Hamming distance
of two sketches is at most the size of the symmetric difference of the sets. A pair with Jaccard similarity t or more
differs in at most D = (1 - t) / (1 + t) x (|A| + |B|) tokens, so of D + 1 segments of the sketches one is equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.common import fresh, runs, stash
from quirework.llm.components import components
from quirework.llm.text import U, mix, ngrams, words

#: Word bigrams; pairs of this similarity or more; equal segments expected of a pair at the threshold.
N, THRESHOLD, EXPECTED = 2, 0.55, 3.5
#: Tokens in a segment, at least, on average; fewer say too little about the text.
FILL = 4.0
#: Sets of fewer tokens have D + 1 segments, however few tokens those hold, in three sketches.
SMALL = 16
#: Documents compared at a time within a component: a pair of blocks is a task's unit of work.
BLOCK = 512
ROWS = 500
#: Tokens of sets that are sketched together, about.
PART = 1 << 19


@lru_cache(maxsize=4096)
def scheme(band: int, t: float) -> tuple[int, int]:
    """(segments, sketches) for the sets of a band, with sizes from (1 / t)^band to (1 / t)^(band + 2).

    Sets of fewer than ``SMALL`` tokens have D + 1 segments: of those of a pair, one is equal. For larger ones as many
    segments would hold under two tokens each at t = 0.55, so that nearly all documents would meet, and so theirs are fewer
    and longer, D + 1 only where that gives ``FILL`` tokens each, and there are as many independent sketches as are needed
    for ``EXPECTED`` equal segments, of two common tokens or more, of a pair that differs in D tokens. Such a pair, exactly
    at the threshold, is missed with probability e^-3.5 = 0.03 in a band, and 0.001 if it shares both its bands.
    """
    size = max(1.0, t ** -(band + 1))
    apart = (1 - t) / (1 + t) * 2 * size
    exact = int(apart) + 1
    if size < SMALL:
        return exact, 3
    if size / exact >= FILL:
        return exact, 1

    def equal(k: int) -> float:
        """Segments, of k, without a token that differs, and with two of those in common (Poisson)."""
        common = (size - apart / 2) / k
        return k * math.exp(-apart / k) * (1 - (1 + common) * math.exp(-common))

    k = max(2, int(size / FILL))
    while k > 2 and equal(k - 1) >= EXPECTED:
        k -= 1
    return k, max(1, math.ceil(EXPECTED / equal(k)))


def token_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of each row, sorted, and their offsets; fewer than n words are one gram."""
    g, at = ngrams(*words(texts), n, whole=True)
    sets = [np.unique(g[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else g), np.concatenate([[0], np.cumsum(size)])


def bands(size: int, t: float) -> tuple[int, int]:
    """The two bands of a set. The larger of two similar sets has at most 1 / t times the tokens: they share a band."""
    b = int(math.floor(math.log(size) / -math.log(t) + 1e-9))
    return b - 1, b


def keys(tokens: np.ndarray, t: float) -> np.ndarray:
    """``all_keys`` of one set."""
    return all_keys(tokens, np.array([0, len(tokens)]), t)[0]


def all_keys(tokens: np.ndarray, at: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the segments of all sketches of each set, and the row of each: the XOR of the codes of a segment's bits,
    in which tokens of equal bits cancel out, with the numbers of band, sketch and segment.

    A segment has 2^32 bits, held sparsely. Segments of a single token are passed over, unless the set has fewer than
    ``SMALL``; and every set has one key for the whole of it. The sets of a band are taken together, up to ``PART`` tokens.
    """
    size = np.diff(at)
    rows = np.flatnonzero(size)
    if not len(rows):
        return tokens[:0], rows
    out, of = [mix(np.bitwise_xor.reduceat(mix(tokens), at[:-1][rows]) + size[rows].astype(U))], [rows]
    band = np.array([bands(n, t)[1] for n in size[rows].tolist()])
    for b in np.unique(np.concatenate([band - 1, band])).tolist():
        segments, sketches = scheme(b, t)
        mine = rows[(band == b) | (band - 1 == b)]
        for part in np.split(mine, np.flatnonzero(np.diff(np.cumsum(size[mine]) // PART)) + 1):
            n = size[part]
            row = np.repeat(np.arange(len(part)), n)
            token = tokens[np.repeat(at[part] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            least = np.repeat(np.where(n >= SMALL, 2, 1), segments)
            for s in range(sketches):
                x = mix(token ^ mix(np.array([(b + 2) * 1009 + s], U)))
                seg = ((x >> U(32)) * U(segments)) >> U(32)
                place = row * segments + seg.astype(np.int64)
                code = np.zeros(len(least), U)
                np.bitwise_xor.at(code, place, mix((x & U(0xFFFFFFFF)) + (seg << U(32))))
                used = np.flatnonzero(np.bincount(place, minlength=len(least)) >= least)
                out.append(mix(code[used] ^ mix((used % segments).astype(U) + (U(b + 2) << U(32)) + (U(s) << U(48)))))
                of.append(part[used // segments])
    return np.concatenate(out), np.concatenate(of)


def _grams(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that can be compared: those with an id and a text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''")


def links(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(key, a, b), a > b: each document with the least id of every bucket that it is in. Linear in the keys.

    Keys are shuffled and sorted by Spark and then read as a stream, so that a bucket of any size needs no memory. The
    key is null for buckets that are seen to hold one link: it is all of their pairs.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                tokens, at = token_sets(part.column(1), n)
                key, row = all_keys(tokens, at, t)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part.column(0).to_numpy()[row])], ["key", "id"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None
        for b in batches:
            if not b.num_rows:
                continue
            k, i = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
            lead = np.concatenate([[head if head is not None else 0], i[new]])[np.cumsum(new)]
            run = np.cumsum(new)
            held = np.bincount(run)
            # a bucket that may go on before or after this batch counts as one of more
            alone = (held[run] == 2) & (run > 0) & (run < run[-1])
            key, head = k[-1], lead[-1]
            ok = i != lead
            one = np.unique(np.stack([i[ok & alone], lead[ok & alone]]), axis=1)
            many = ok & ~alone
            keyed = pa.concat_arrays([pa.nulls(one.shape[1], pa.int64()), pa.array(k[many])])
            yield pa.RecordBatch.from_arrays([keyed, pa.array(np.concatenate([one[0], i[many]])), pa.array(np.concatenate([one[1], lead[many]]))], ["key", "a", "b"])

    rows = _grams(docs).mapInArrow(emit, "key long, id long")
    return stash(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(star, "key long, a long, b long"))


def spread(docs: DataFrame, want: DataFrame, n: int, data: Callable[[np.ndarray], bytes], broadcast_ids: int) -> DataFrame:
    """(to, tag, side, id, n, data), sorted by to and id within partitions: what is made of the tokens of each document, for
    every row (id, to, tag, side) of ``want``. Documents are read again, and only those wanted pass the join.

    Up to ``broadcast_ids`` rows wanted, counted first, go to the executors; with more, documents are shuffled by id.
    """
    few = want.limit(broadcast_ids + 1).count() <= broadcast_ids
    by_id = want.groupBy("id").agg(F.collect_list(F.struct("to", "tag", "side")).alias("want"))
    mine = _grams(docs).join(F.broadcast(by_id) if few else by_id, F.col("doc_id") == F.col("id")).select("doc_id", "text", "want.to", "want.tag", "want.side")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                tokens, at = token_sets(part.column(1), n)
                each = pa.array([data(tokens[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
                times = pa.array(np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(2)).to_numpy()))
                size = pa.array(np.diff(at).astype(np.int32)).take(times)
                sent = pa.RecordBatch.from_arrays([*(part.column(k).flatten() for k in (2, 3, 4)), part.column(0).take(times), size, each.take(times)], ["to", "tag", "side", "id", "n", "data"])
                yield sent.filter(pc.greater(size, 0))

    return mine.mapInArrow(make, "to long, tag long, side int, id long, n int, data binary").repartition("to").sortWithinPartitions("to", "id", "data")


def sketch(tokens: np.ndarray) -> bytes:
    """The parity sketch of a set in 2 to 4 bits a token, a power of two."""
    width = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of two sketches; the wider one is folded, by XOR, to the width of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token."""
    return (tokens >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: pa.Scalar) -> np.ndarray:
    x = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return np.unique(out.view("<u8").reshape(-1))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def against_head(docs: DataFrame, pairs: DataFrame, n: int, t: float, exact: bool, broadcast_ids: int) -> DataFrame:
    """The pairs (a, b) that may be similar, by the distance of their sketches, or, if ``exact``, that are, by their
    tokens. The set of b, which is less than all its a, is read first and held while theirs pass."""
    head = pairs.select(F.col("b").alias("id"), F.col("b").alias("to")).distinct()
    want = pairs.select(F.col("a").alias("id"), F.col("b").alias("to")).union(head).withColumns({"tag": F.lit(0).cast("long"), "side": F.lit(0)})
    rows = spread(docs, want, n, packed if exact else sketch, broadcast_ids)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = last = None
        size, first = 0, np.zeros(0, U)
        for b in batches:
            out: list[tuple[int, int]] = []
            for to_, i, m, x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                if to_ != to:
                    to, size, last = to_, m, i
                    first = unpacked(x) if exact else np.frombuffer(x.as_buffer(), np.uint8).copy()
                elif i != last and i != to:
                    last = i
                    if min(m, size) < t * max(m, size) - 1e-9:
                        continue
                    if exact:
                        ok = similarity(unpacked(x), first) >= t - 1e-12
                    else:
                        ok = hamming(np.frombuffer(x.as_buffer(), np.uint8), first) <= (1 - t) / (1 + t) * (m + size) + 1e-9
                    if ok:
                        out.append((i, to_))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(one, "a long, b long")


def near(docs: DataFrame, marks: DataFrame, n: int, t: float, broadcast_ids: int) -> DataFrame:
    """The links of all buckets, ``marks``, whose sketches are near enough."""
    return stash(against_head(docs, stash(marks.select("a", "b").distinct()), n, t, False, broadcast_ids))


def blocks(member: DataFrame, group: str, tag: str) -> DataFrame:
    """(id, to, tag, side): the tasks that compare all pairs of each group of (id, group, tag), each pair in one of them:
    a block of ``BLOCK`` documents with itself (side 0), or two blocks with one another (sides 1 and 2)."""
    w = Window.partitionBy(group)
    placed = member.withColumn("block", F.floor((F.row_number().over(w.orderBy("id")) - 1) / BLOCK)).withColumn("blocks", F.ceil(F.count("*").over(w) / BLOCK))
    tasks = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return tasks.select("id", F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other")).alias("to"), F.col(tag).cast("long").alias("tag"), side.alias("side"))


def each_task(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(id, tag, side, n, data) of each task out of the rows of ``spread``; of the rows of one id the first."""
    for tab in runs(batches, "to"):
        to, tag, side, ids, n = (tab.column(i).to_numpy() for i in range(5))
        data = tab.column(5).combine_chunks()
        first = np.concatenate([[True], (to[1:] != to[:-1]) | (ids[1:] != ids[:-1])])
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            keep = s + np.flatnonzero(first[s:e])
            if len(keep) > 1:
                yield ids[keep], tag[keep], side[keep], n[keep], data.take(pa.array(keep))


def rest(docs: DataFrame, marks: DataFrame, root: DataFrame, n: int, t: float, exact: bool, broadcast_ids: int) -> DataFrame:
    """(a, b): links across the components (id, root) of the documents of a bucket, out of all its pairs.

    A link to the least id of a bucket says nothing of the others, so where a bucket has documents of more than one
    component, all pairs across them are compared: by their sketches, and if ``exact``, those near by their tokens too.
    Of buckets with equal documents one is read. A bucket's sketches are sent to its tasks, not its pairs, which are
    quadratic in the bucket.
    """
    marks = marks.filter("key is not null")
    held = marks.select("key", F.col("a").alias("id")).union(marks.select("key", F.col("b").alias("id"))).distinct()
    held = stash(held.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    mixed = held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("docs"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sum")).filter("x <> y")
    held = held.join(mixed.groupBy("docs", "sum").agg(F.min("key").alias("key")).select("key"), "key")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, roots, side, size, data in each_task(batches):
            x, y = _near_pairs(roots, side, size, [np.frombuffer(d.as_buffer(), np.uint8) for d in data], t)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids[x], ids[y])), pa.array(np.minimum(ids[x], ids[y]))], ["a", "b"])

    found = stash(spread(docs, stash(blocks(held, "key", "root")), n, sketch, broadcast_ids).mapInArrow(across, "a long, b long").distinct())
    return stash(against_head(docs, found, n, t, True, broadcast_ids)) if exact else found


def _near_pairs(roots: np.ndarray, side: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of different roots and near sketches, by products of the bits; the wider ones are folded."""
    width = np.array([len(s) for s in sketches])
    groups = [(int(w), np.flatnonzero(width == w)) for w in np.unique(width)]
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for i, (w, a) in enumerate(groups):
        left = np.stack([sketches[k] for k in a])
        for v, b in groups[i:]:
            right = left if v == w else np.bitwise_xor.reduce(np.stack([sketches[k] for k in b]).reshape(len(b), v // w, w), axis=1)
            apart = np.bitwise_count(left).sum(1, dtype=np.float32)[:, None] + np.bitwise_count(right).sum(1, dtype=np.float32)
            for k in range(0, w, 512):
                p = np.unpackbits(left[:, k : k + 512], axis=1).astype(np.float32)
                q = p if v == w else np.unpackbits(right[:, k : k + 512], axis=1).astype(np.float32)
                apart -= 2 * (p @ q.T)
            m, o = size[a][:, None], size[b]
            ok = (roots[a][:, None] != roots[b]) & ((side[a][:, None] == 0) | (side[a][:, None] != side[b]))
            ok &= (np.minimum(m, o) >= t * np.maximum(m, o) - 1e-9) & (apart <= (1 - t) / (1 + t) * (m + o) + 1e-9)
            x, y = np.nonzero(np.triu(ok) if v == w else ok)
            found.append((a[x], b[y]))
    x, y = (np.concatenate(z) for z in zip(*found, strict=True))
    return x, y


def candidates(docs: DataFrame, n: int, t: float, broadcast_ids: int) -> DataFrame:
    """(id, root): components of documents that may be similar. Buckets of equal segments link each of their documents to
    the least; links whose sketches are near enough make components; where a bucket has documents of several, all its
    pairs across them are compared, and those near enough join them."""
    marks = links(docs, n, t)
    member = stash(components(near(docs, marks, n, t, broadcast_ids)))
    more = rest(docs, marks, member, n, t, False, broadcast_ids)
    if more.limit(1).count():
        member = stash(components(member.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)))
    return member


def join(docs: DataFrame, n: int = N, t: float = THRESHOLD, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: all pairs of documents whose sets of word n-grams are similar.

    Within a component of ``candidates`` all pairs are verified, block by block of ``BLOCK`` documents, through the product
    of the incidence matrix of its tokens. A pair is missed only if its documents are in different components. The rows
    are the square of a group of copies; ``classes`` says as much of large tables in a row for each document.

    Null ids aren't reported. Null and empty texts and those without a word are like nothing. A text of fewer than n
    words is one gram. Repeated rows (one id) are one document, and if their texts differ the least packed set counts.
    Ties: pairs at the threshold are given. Long texts: whole. No rows: none. Extra columns aren't passed on.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, side, _, data in each_task(batches):
            x, y, j = _pairs(ids, [unpacked(d) for d in data], side, t)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(j)], ["doc_a", "doc_b", "jaccard"])

    want = blocks(candidates(docs, n, t, broadcast_ids), "root", "root")
    return spread(docs, want, n, packed, broadcast_ids).mapInArrow(one, "doc_a long, doc_b long, jaccard double")


def classes(docs: DataFrame, n: int = N, t: float = THRESHOLD, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(doc_id, class_id, links): for every document the number of others whose sets of word n-grams are similar to its
    own, and the least id of those that it is linked to, directly or through others (its own, if to none).

    Equal texts are one, the one of the least id, until they are counted: a link to it is a link to each of its copies. All
    pairs of different texts in a component of ``candidates`` are verified, block by block, as in ``join``, but only
    counted, and a task gives each document with the least of those that it is linked to there.

    Null ids aren't reported. Null and empty texts and those without a word have no links. A text of fewer than n words is one
    gram. Repeated rows (one id) are one document, and if their texts differ the one of the least MD5 counts. Ties: a pair
    at the threshold is a link. Long texts: whole. No rows: none. Extra columns aren't passed on.
    """

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(broadcast_ids + 1).count() <= broadcast_ids else df

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    hash_ = F.when(F.col("text").rlike(r"[\p{L}\p{M}\p{N}]"), F.unhex(F.md5(F.col("text").cast("binary"))))
    told = stash(rows.groupBy("doc_id").agg(F.min(hash_).alias("hash"), F.max(hash_).alias("other")))
    copied = stash(told.filter("hash is not null").groupBy("hash").agg(F.min("doc_id").alias("of"), F.count("*").alias("copies")).filter("copies > 1"))
    told = stash(told.join(few(copied), "hash", "left").select("doc_id", "hash", (F.col("hash") != F.col("other")).alias("several"), F.coalesce("of", "doc_id").alias("of"), F.coalesce("copies", F.lit(1)).alias("copies")))
    texts = rows.join(few(told.filter("of <> doc_id").select("doc_id")), "doc_id", "left_anti")
    several = told.filter("several").select("doc_id", "hash")
    if several.limit(1).count():
        texts = texts.join(few(several), "doc_id", "left").filter(F.col("hash").isNull() | (F.col("hash") == hash_)).select("doc_id", "text")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, copies, side, _, data in each_task(batches):
            x, y, _ = _pairs(np.arange(len(ids)), [unpacked(d) for d in data], side, t)
            if not len(x):
                continue
            count = np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            root = _least(x, y, len(ids))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]]), pa.array(count[some].astype(np.int64))], ["id", "root", "links"])

    member = candidates(texts, n, t, broadcast_ids)
    member = member.join(few(told.filter("copies > 1 and of = doc_id").select(F.col("doc_id").alias("id"), "copies")), "id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    found = stash(spread(texts, stash(blocks(member, "root", "copies")), n, packed, broadcast_ids).mapInArrow(one, "id long, root long, links long"))
    linked = found.groupBy("id").agg(F.sum("links").alias("links")).join(components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))), "id").withColumnRenamed("id", "of")
    own = F.col("copies") - 1
    return told.join(few(stash(linked)), "of", "left").select("doc_id", F.coalesce("root", "of").alias("class_id"), (F.coalesce("links", F.lit(0)) + own).alias("links"))


def _least(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least of the component of each of n rows, by the links x, y."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        # and on from there
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pairs(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The similar pairs of a task: of one block with itself (side 0), or across two blocks (sides 1 and 2)."""
    size = np.array([len(s) for s in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    row, token = row[count[token] > 1], token[count[token] > 1]
    _, token = np.unique(token, return_inverse=True)
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = int(token[-1]) + 1 if len(token) else 0
    for a in range(0, width, 4096):
        lo, hi = np.searchsorted(token, [a, a + 4096])
        m = np.zeros((len(sets), min(4096, width - a)), np.float32)
        m[row[lo:hi], token[lo:hi] - a] = 1
        both += m @ m.T
    x, y = np.triu_indices(len(sets), 1)
    j = both[x, y].astype(float)
    j /= size[x] + size[y] - j
    ok = (j >= t - 1e-12) & ((side[x] == 0) | (side[x] != side[y]))
    x, y = x[ok], y[ok]
    return np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.round(j[ok], 6)


def groups(docs: DataFrame, n: int = N, t: float = THRESHOLD, broadcast_ids: int = 2_000_000) -> DataFrame:
    """(id, root) of all documents that have a near copy: the components of verified links.

    First the link of each document to the least other is verified; then those links that would join two components;
    then, of buckets whose documents are still in several, all pairs across them. The work is linear in the links but for those.

    Null ids, null and empty texts and those without a word have no near copy. Repeated rows (one id) are one document.
    Ties: a pair at the threshold is similar. Long texts: whole. No rows: none. Extra columns aren't passed on.
    """
    marks = links(docs, n, t)
    found = near(docs, marks, n, t, broadcast_ids)
    first = found.groupBy("a").agg(F.min("b").alias("b"))
    sure = stash(against_head(docs, first, n, t, True, broadcast_ids))
    root = stash(components(sure))
    left = found.join(first, ["a", "b"], "left_anti")
    for c in ("a", "b"):
        r = root.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
        left = left.join(r, c, "left").withColumn(f"root_{c}", F.coalesce(f"root_{c}", c))
    left = stash(left.filter("root_a <> root_b").select("a", "b"))
    tree = root.select(F.col("id").alias("a"), F.col("root").alias("b"))
    if left.limit(1).count():
        root = stash(components(tree.union(against_head(docs, left, n, t, True, broadcast_ids))))
        tree = root.select(F.col("id").alias("a"), F.col("root").alias("b"))
    more = rest(docs, marks, root, n, t, True, broadcast_ids)
    return components(tree.union(more)) if more.limit(1).count() else root


def keep_one(docs: DataFrame, n: int = N, t: float = THRESHOLD, broadcast_ids: int = 2_000_000) -> DataFrame:
    """``docs`` with one document, that of the least id, of each component of similar documents; others are all kept.

    Rows that share an id are one document and one of them stays; rows without an id all stay, as do null and empty texts
    and those without a word. Ties: a pair at the threshold is similar. Long texts: whole. No rows: none. Columns are
    neither added nor replaced, whatever their names.
    """
    gone, name = stash(groups(docs, n, t, broadcast_ids).filter("id <> root").select("id")), fresh(docs, "near_id")
    few = gone.limit(broadcast_ids + 1).count() <= broadcast_ids
    gone = gone.withColumnRenamed("id", name)
    kept = docs.join(F.broadcast(gone) if few else gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        w = fresh(docs, "near_row")
        order = [F.col(f"`{c}`").cast("string") for c in docs.columns]
        # rows without an id are spread by what they hold
        one = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(*order))).orderBy(*order)
        kept = kept.withColumn(w, F.row_number().over(one)).filter(F.col(w).eqNullSafe(1) | F.col("doc_id").isNull()).drop(w)
    return kept
