import random
from collections import Counter, defaultdict

from quirework.llm.sharding import pack, shard
from tests.llm.helpers import DOCS, HARD, docs


def one_by_one(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= s]
        if s > capacity:
            bins.append([-1, s])
        elif fits:
            b = min(fits, key=lambda b: b[0])
            b[0] -= s
            b.append(s)
        else:
            bins.append([capacity - s, s])
    return sorted(sum(b[1:]) for b in bins)  # which of equally full shards a group enters is a tie


def test_pack_is_best_fit_decreasing():
    for t in range(300):
        r = random.Random(t)
        capacity = r.choice([5, 10, 37, 100])
        sizes = [r.randint(0, capacity + 3) for _ in range(r.randint(0, 80))]
        count, got, seen = Counter(sizes), defaultdict(list), Counter()
        for s, first, per, start, n in pack(sorted(count.items(), reverse=True), capacity):
            for i in range(n):
                take = min(per, count[s] - first - i * per)
                got[start + i] += [s] * take
                seen[s] += take
        assert seen == count
        assert sorted(map(sum, got.values())) == one_by_one(sizes, capacity)


def test_shard_table(spark):
    r = random.Random(3)
    texts = ["z" * r.randint(0, 30) for _ in range(300)]
    out = shard(docs(spark, texts), 64).collect()
    assert len(out) == 300
    shards, where = defaultdict(dict), defaultdict(set)
    for x in out:
        shards[x["shard_id"]][x["text"]] = x["group_bytes"]
        where[x["text"]].add(x["shard_id"])
    assert all(len(v) == 1 for v in where.values())
    groups = [len(t) * n for t, n in Counter(texts).items()]
    assert sorted(sum(v.values()) for v in shards.values()) == one_by_one(groups, 64)


def test_groups_of_columns_and_sizes(spark):
    out = shard(docs(spark, ["ab", "cd", "e", "f"]), 3, group=["source"]).collect()
    assert {(x["source"], x["group_bytes"]) for x in out} == {("s0", 3), ("s1", 3)} and len({x["shard_id"] for x in out}) == 2


def test_hard_rows(spark):
    d = docs(spark, HARD, ids=[0, 1, 2, None, 3, 4, 5, 6, 7, 7])
    out = shard(d.selectExpr("*", "1 rank", "2 shard_key", "3 SHARD_ID", "4 size"), 100)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rank", "shard_key", "size", "shard_id", "group_bytes"]
    rows = out.collect()
    assert len(rows) == len(HARD) and all(x["shard_id"] is not None for x in rows)
    assert len({x["shard_id"] for x in rows if x["text"] == "one two three four"}) == 1
    assert shard(spark.createDataFrame([], DOCS), 10).collect() == []
    assert shard(d, 10, group=["doc_id", "lang"], keep=["lang"]).columns == ["lang", "shard_id", "group_bytes"]


def test_most_groups_of_one_size(spark):
    # chunks of a fixed length, of which every shard takes three, and some smaller texts
    texts = [f"{i:010d}" for i in range(400)] + [f"{i:04d}" for i in range(50)]
    out = shard(docs(spark, texts), 34).collect()
    load = defaultdict(int)
    for x in out:
        load[x["shard_id"]] += len(x["text"])
    assert len(out) == 450 and sorted(load.values()) == one_by_one([len(t) for t in texts], 34)
