import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import jaccard_join
from quirework.llm.components import components
from quirework.llm.jaccard_join import THRESHOLD, all_keys, bands, classes, hamming, join, keep_one, keys, packed, scheme, similarity, sketch, token_sets, unpacked
from quirework.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import DOCS, HARD, docs


def near_copies(seed, n):
    """Texts of 3 to 300 words; of each, copies with 0 to 20 % of the words changed."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [f"w{r.randint(0, 3000) if r.random() < 0.7 else r.randint(0, 20)}" for _ in range(r.choice([3, 8, 20, 60, 150, 300]))]
        for _ in range(r.choice([1, 1, 2, 3, 6])):
            rate = r.choice([0, 0.02, 0.05, 0.1, 0.2])
            texts.append(" ".join(f"v{r.randint(0, 3000)}" if r.random() < rate else w for w in base))
    return texts


def all_pairs(texts, t=THRESHOLD):
    tokens, at = token_sets(pa.array(texts), 2)
    sets = [tokens[a:b] for a, b in zip(at, at[1:], strict=False)]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i]) and len(sets[j]) and similarity(sets[i], sets[j]) >= t}


def test_sketches_bound_the_difference():
    """The Hamming distance of two parity sketches is at most the symmetric difference of the sets."""
    r = np.random.default_rng(1)
    for _ in range(200):
        pool = r.integers(0, 2**63, 900, dtype=np.uint64)
        a, b = (np.unique(r.choice(pool, r.integers(1, 800))) for _ in range(2))
        x, y = (np.frombuffer(sketch(s), np.uint8) for s in (a, b))
        assert hamming(x, y) == hamming(y, x) <= len(np.setxor1d(a, b)) and hamming(x, x) == 0
        assert (unpacked(pa.scalar(packed(a))) == np.unique(a >> np.uint64(16))).all()


def test_equal_keys_are_found_at_the_threshold():
    r = np.random.default_rng(2)
    for n in (6, 14, 40, 200, 1500):
        hit, trials = 0, 60
        for _ in range(trials):
            x = r.integers(0, 2**63, 3 * n, dtype=np.uint64)
            apart = int(2 * n * (1 - THRESHOLD) / (1 + THRESHOLD)) // 2
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[: n - apart], x[n : n + apart]]))
            assert similarity(a, b) >= THRESHOLD
            hit += bool(set(keys(a, THRESHOLD)) & set(keys(b, THRESHOLD)))
        assert hit >= 0.9 * trials, n


def test_similar_sizes_share_a_band():
    for n in range(1, 3000, 7):
        for m in range(n, int(n / THRESHOLD) + 1, max(1, n // 5)):
            assert set(bands(n, THRESHOLD)) & set(bands(m, THRESHOLD))
    assert all(k >= 1 and s >= 1 for k, s in (scheme(b, THRESHOLD) for b in range(-1, 30)))


def test_recall_against_brute_force(spark):
    texts = near_copies(4, 120)
    want = all_pairs(texts)
    got = {(r["doc_a"], r["doc_b"]) for r in join(docs(spark, texts)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 100


def test_large_groups_by_blocks_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    texts = ["one of many copies that differ in the last word only " * 3 + f"x{i}" for i in range(40)] + near_copies(5, 10)
    want = all_pairs(texts)
    rows = join(docs(spark, texts), broadcast_ids=0).collect()
    assert len(rows) == len({(r["doc_a"], r["doc_b"]) for r in rows}) and {(r["doc_a"], r["doc_b"]) for r in rows} == want


def hub(seed, words, rate, copies=300):
    """Independently edited copies of one text, which stands in the middle of them."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    texts = [" ".join(f"v{r.randint(0, 5000)}" if r.random() < rate else w for w in base) for _ in range(copies)]
    return [*texts[: copies // 2], " ".join(base), *texts[copies // 2 :]]


def test_copies_of_a_hub_that_is_not_the_least(spark):
    for words, rate in ((200, 0.15), (800, 0.15)):
        texts = hub(9, words, rate)
        want = all_pairs(texts)
        got = {(r["doc_a"], r["doc_b"]) for r in join(docs(spark, texts)).collect()}
        assert got <= want and len(got) >= 0.97 * len(want) > 50, (words, rate, len(got), len(want))


def groups_by_brute_force(texts):
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(all_pairs(texts)):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {find(i) for i in range(len(texts))}


def test_one_of_hundreds_of_edited_copies_stays(spark):
    for words, rate in ((200, 0.1), (800, 0.1), (200, 0.15)):
        texts = hub(10, words, rate)
        want = groups_by_brute_force(texts)
        got = {r["doc_id"] for r in keep_one(docs(spark, texts)).collect()}
        assert want <= got and len(got - want) <= 0.03 * len(texts), (words, rate, len(got), len(want))


def test_one_of_each_group_stays(spark):
    texts = near_copies(6, 80)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(all_pairs(texts)):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {find(i) for i in range(len(texts))}
    for m in (10**6, 0):
        got = {r["doc_id"] for r in keep_one(docs(spark, texts), broadcast_ids=m).collect()}
        assert want <= got and len(got - want) <= 0.03 * len(texts)


def test_components(spark):
    r = random.Random(2)
    edges = [(i + 1, i) for i in range(60)] + [(r.randint(100, 200), r.randint(100, 200)) for _ in range(70)] + [(300, 300)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x["id"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_hard_rows(spark):
    d = docs(spark, [*HARD, None, "one two three four"], ids=[0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, None]).selectExpr("*", "1 id", "2 root", "3 near_id", "4 tokens", "5 key")
    assert [(r["doc_a"], r["doc_b"]) for r in join(d).collect()] == []
    more = d.unionByName(d.filter("doc_id in (3, 5, 8)").distinct().withColumn("doc_id", d["doc_id"] + 20))
    assert {(r["doc_a"], r["doc_b"], r["jaccard"]) for r in join(more).collect()} == {(3, 23, 1.0), (5, 25, 1.0), (8, 28, 1.0)}
    kept = keep_one(more)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "None"])
    empty = spark.createDataFrame([], DOCS)
    assert join(empty).collect() == [] and keep_one(empty).collect() == []


def test_keys_of_many_sets_are_those_of_each():
    tokens, at = token_sets(pa.array([*near_copies(7, 40), "", None, *near_copies(8, 10)]), 2)
    key, row = all_keys(tokens, at, THRESHOLD)
    for i in range(len(at) - 1):
        assert sorted(key[row == i].tolist()) == sorted(keys(tokens[at[i] : at[i + 1]], THRESHOLD).tolist())
    assert set(row.tolist()) == set(np.flatnonzero(np.diff(at)).tolist())


def test_near_sketches_against_all_pairs():
    tokens, at = token_sets(pa.array(near_copies(12, 40)), 2)
    sets = [tokens[a:b] for a, b in zip(at, at[1:], strict=False)]
    size, sketches = np.array([len(s) for s in sets]), [np.frombuffer(sketch(s), np.uint8) for s in sets]
    r = np.random.default_rng(3)
    roots = r.integers(0, 3, len(sets))
    for side in (np.zeros(len(sets), int), r.integers(1, 3, len(sets))):
        x, y = jaccard_join._near_pairs(roots, side, size, sketches, THRESHOLD)
        far = (1 - THRESHOLD) / (1 + THRESHOLD)
        want = {(i, j) for i in range(len(sets)) for j in range(i) if roots[i] != roots[j] and (side[i] == 0 or side[i] != side[j]) and min(size[i], size[j]) >= THRESHOLD * max(size[i], size[j]) - 1e-9 and hamming(sketches[i], sketches[j]) <= far * (size[i] + size[j]) + 1e-9}
        got = list(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist(), strict=True))
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 5


def classes_by_brute_force(texts):
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in all_pairs(texts):
        links[a] += 1
        links[b] += 1
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {(i, find(i), links[i]) for i in range(len(texts))}


def test_classes_count_all_links_in_a_row_for_each_document(spark, monkeypatch):
    texts = ["one of many copies that differ in the last word only " * 3 + f"x{i % 9}" for i in range(60)] + near_copies(5, 30) + ["same"] * 40 + ["", ".", "."]
    want = classes_by_brute_force(texts)
    assert sum(x[2] for x in want) > 20 * len(texts)
    for block, limit in ((512, 10**6), (7, 0)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        rows = classes(docs(spark, texts), broadcast_ids=limit).collect()
        assert len(rows) == len(texts)
        assert len({tuple(x) for x in rows} - want) <= 0.02 * len(texts)


def test_classes_of_hard_rows(spark):
    d = docs(spark, [*HARD, None, "one two three four", "x y z", "p q r s", "p q r s"], ids=[0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, None, 10, 10, 11]).selectExpr("*", "1 id", "2 root", "3 hash", "4 copies", "5 of")
    # of the texts of 10, the one of the least MD5 counts
    same = min("x y z", "p q r s", key=lambda x: hashlib.md5(x.encode()).hexdigest()) == "p q r s"
    more = d.unionByName(d.filter("doc_id in (3, 5, 8)").distinct().withColumn("doc_id", d["doc_id"] + 20))
    want = {(i, i, 0) for i in (0, 1, 2, 4, 6, 7, 9)} | {(i + k, i, 1) for i in (3, 5, 8) for k in (0, 20)} | {(10, 10, int(same)), (11, 10 if same else 11, int(same))}
    for limit in (10**6, 0):
        rows = classes(more, broadcast_ids=limit).collect()
        assert len(rows) == len(want) and {tuple(x) for x in rows} == want
    assert classes(spark.createDataFrame([], DOCS)).collect() == []


def test_op6_has_a_row_for_each_document_and_that_of_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [*HARD[:6], *near_copies(13, 25), *["copied text of a few words"] * 30]
    docs(spark, texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in QUERIES["op6_jaccard_join"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(ORACLES["op6_jaccard_join"]).fetchall()
    assert len(got) == len(texts) and sorted(got) == sorted(want)
