"""Sharding: indivisible groups of documents into shards of fixed capacity, by best-fit-decreasing bin packing."""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.llm.common import fresh, stash, without

#: Parts by hash that groups of one size are ranked in.
PARTS = 64
RUNS = "size long, first long, per_shard long, shard long, shards long"


class Tree:
    """A treap from remaining capacity to the shards that have it, as ranges; finds the least key that is enough."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.rng = random.Random(0)

    def tightest(self, need: int) -> list | None:
        node, best = self.root, None
        while node:
            if node[0] >= need:
                node, best = node[3], node
            else:
                node = node[4]
        return best

    def add(self, key: int, start: int, n: int) -> None:
        node = self.root
        while node:
            if node[0] == key:
                node[2].append((start, n))
                return
            node = node[3] if key < node[0] else node[4]
        left, right = self._split(self.root, key)
        self.root = self._join(self._join(left, [key, self.rng.random(), [(start, n)], None, None]), right)

    def remove(self, key: int) -> None:
        left, rest = self._split(self.root, key)
        _, right = self._split(rest, key + 1)
        self.root = self._join(left, right)

    def _split(self, node: list | None, key: int) -> tuple[list | None, list | None]:
        """Nodes with smaller keys, and the others."""
        if not node:
            return None, None
        if node[0] < key:
            node[4], right = self._split(node[4], key)
            return node, right
        left, node[3] = self._split(node[3], key)
        return left, node

    def _join(self, a: list | None, b: list | None) -> list | None:
        if not a or not b:
            return a or b
        if a[1] > b[1]:
            a[4] = self._join(a[4], b)
            return a
        b[3] = self._join(a, b[3])
        return b


def pack(sizes: Iterable[tuple[int, int]], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Best fit decreasing over (size, how many groups have it), largest size first.

    Yields (size, first, per_shard, shard, shards): of the groups of that size, those from rank ``first`` on go
    ``per_shard`` each into ``shards`` shards from number ``shard`` on. Groups of one size are interchangeable and a
    group put into the tightest shard makes it tighter, so equal groups fill one shard after another: the result is
    that of placing one at a time, and the work grows with the number of different sizes, not of groups.
    """
    tree, opened = Tree(), 0
    for size, count in sizes:
        rank = 0
        if size > capacity:
            yield size, 0, 1, opened, count
            opened += count
            continue
        while rank < count:
            node = tree.tightest(size)
            if node is None:
                n = -(-(count - rank) // (capacity // size)) if size else 1
                tree.add(capacity, opened, n)
                opened += n
                continue
            room, spans = node[0], node[2]
            start, n = spans.pop()
            fit = room // size if size else count - rank
            per, take = (fit, min(n, (count - rank) // fit)) if count - rank >= fit else (count - rank, 1)
            yield size, rank, per, start, take
            if n > take:
                spans.append((start + take, n - take))
            if not spans:
                tree.remove(room)
            tree.add(room - per * size, start, take)
            rank += per * take


def plan(histogram: DataFrame, capacity: int) -> DataFrame:
    """The runs of ``pack``. One task sees the histogram, at most ``capacity`` + 1 sizes that fit and those that don't."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for run in pack(((int(s), int(n)) for f in frames for s, n in zip(f["size"], f["n"], strict=True)), capacity):
            rows.append(run)
            if len(rows) == 50_000:
                yield pd.DataFrame(rows, columns=["size", "first", "per_shard", "shard", "shards"])
                rows = []
        yield pd.DataFrame(rows, columns=["size", "first", "per_shard", "shard", "shards"])

    return histogram.repartition(1).sortWithinPartitions(F.desc("size")).mapInPandas(one, RUNS)


def shard(docs: DataFrame, capacity: int, group: Sequence[str] | None = None, size: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``shard_id`` and ``group_bytes``; rows of one group share a shard.

    group: the columns that make a group; None: the text, so that copies of a document are never split.
    size: the size of a row, by default the bytes of its text. keep: the columns wanted, by default all.
    capacity: the most that a shard holds. A larger group can't be divided and has a shard of its own.

    Only a hash, the size and the columns kept are shuffled. Groups of one size are ranked in ``PARTS`` parts by their
    hash, so that a size that most groups have is spread too; the counts of the parts before add up to each one's offset.
    The plan is made from the histogram of sizes, whose length is bounded by the capacity and not by the data.

    Null text: size 0; rows with null in all group columns are one group. Empty texts: size 0, they go into the
    tightest shard. Ties: by the hash of the group. Repeated rows: of one group, so of one shard. Long texts: by all their bytes. No rows: none.
    Columns named shard_id or group_bytes are replaced; other extra columns are kept.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    key, own = fresh(docs, "shard_key"), fresh(docs, "shard_size")
    of = F.md5(F.coalesce(F.col("text"), F.lit(""))) if group is None else F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in group]), {"ignoreNullFields": "false"}))
    mine = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    rows = docs.withColumn(key, F.unhex(of)).withColumn(own, mine)
    rows = without(rows, "shard_id", "group_bytes")
    if keep is not None:
        rows = rows.select(*[f"`{c}`" for c in keep], key, own)
    groups = rows.groupBy(key).agg(F.sum(own).alias("size"))
    part, w = F.pmod(F.xxhash64(key), F.lit(PARTS)), Window.partitionBy("size", "part")
    ranked = stash(groups.withColumn("part", part).withColumn("rank", F.row_number().over(w.orderBy(key)).cast("long") - 1))
    counts = stash(ranked.groupBy("size", "part").agg(F.count("*").alias("n")))
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    todo = plan(counts.groupBy("size").agg(F.sum("n").alias("n")), capacity)
    # the runs that a part has groups of, with ranks counted from its first one
    reach = (F.col("first") < F.col("offset") + F.col("n")) & (F.col("first") + F.col("per_shard") * F.col("shards") > F.col("offset"))
    first = F.col("first") - F.col("offset")
    starts = offsets.join(todo, "size").filter(reach).select("size", "part", F.greatest(first, F.lit(0)).alias("rank"), F.struct(first.alias("first"), "per_shard", "shard").alias("run"), F.lit(None).cast("binary").alias(key))
    both = ranked.select("size", "part", "rank", F.lit(None).cast("struct<first:bigint,per_shard:bigint,shard:bigint>").alias("run"), key).unionByName(starts)
    along = w.orderBy("rank", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("run", F.last("run", ignorenulls=True).over(along)).filter(F.col(key).isNotNull())
    number = F.col("run.shard") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.per_shard"))
    placed = placed.select(F.col(key), number.cast("long").alias("shard_id"), F.col("size").alias("group_bytes"))
    return rows.join(placed, key).drop(key, own)
