import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quirework.llm import quality_rules
from quirework.llm.jaccard_join import THRESHOLD, similarity, token_sets
from quirework.llm.queries import MIX_SEED, SHARD_BYTES, WEIGHTS, quality_field
from tests.llm.test_sharding import one_by_one


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ba", "ne", "ti", "or", "ul", "sh"]) for _ in range(r.randint(2, 4)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [line(24) for _ in range(6)]
    rows = []
    for i in range(150):
        lines = [line(r.randint(6, 14)) for _ in range(r.randint(3, 9))]
        good = 1
        if i % 6 == 0:
            lines, good = [" ".join(word() + "###" for _ in range(30)) if r.random() < 0.5 else "SALE!! BUY!! NOW!! " * 6 for _ in range(6)], 0
        elif i % 10 == 3:
            lines.insert(1, items[i % 6])
        rows.append([i, "\n".join(lines), "en", f"src{i % 4}", good])
        for _ in range(r.choice([0, 0, 0, 1, 3])):
            copy = [w if r.random() > 0.03 else word() for w in rows[-1][1].split(" ")] if good else rows[-1][1].split(" ")
            rows.append([1000 + len(rows), " ".join(copy), "en", f"src{r.randint(0, 3)}", good])
    rows += [[5000, None, "en", "src1", 0], [5001, "", None, None, 0], [5002, next(x[1] for x in rows if x[4]), "en", None, 1]]
    d = tmp_path_factory.mktemp("sf")
    ids, texts, langs, sources, good = (list(x) for x in zip(*rows, strict=True))
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(x or "") for x in texts], pa.int64())}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array(range(6), pa.int64()), "text": items}), d / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array(good, pa.int32()), "toxic": pa.array([0] * len(ids), pa.int32())}), d / "labels.parquet")
    return str(d), rows, items


def brute(spark, folder):
    """The documents left and their copies, by loops over all pairs."""
    sf, rows, items = folder
    field = quality_field(spark, sf)
    keep = quality_rules.judge(field, pa.array([x[1] for x in rows], pa.string()), 0.5)[3]
    docs = [x for x, k in zip(rows, keep, strict=True) if k]
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    tokens, at = token_sets(pa.array([plain(x[1]) for x in docs]), 2)
    sets = [tokens[a:b] for a, b in zip(at, at[1:], strict=False)]
    parent = {x[0]: x[0] for x in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= THRESHOLD:
                a, b = sorted((find(docs[i][0]), find(docs[j][0])))
                parent[b] = a
    docs = [x for x in docs if find(x[0]) == x[0]]
    grams = lambda t: {tuple(t.split()[i : i + 12]) for i in range(len(t.split()) - 11)}
    bench = set().union(*(grams(plain(t)) for t in items))
    docs = [x for x in docs if not grams(plain(x[1])) & bench]
    n = Counter()
    for x in docs:
        n[x[3]] += len(x[1].split())
    weight = {s: WEIGHTS.get(s, 1.0) for s in n}
    copies = []
    for x in docs:
        rate = weight[x[3]] * float(sum(n.values())) / (sum(weight.values()) * n[x[3]])
        u = int(hashlib.md5(f"{MIX_SEED}:{x[0]}".encode()).hexdigest()[:8], 16) / 2**32
        copies += [x] * (int(rate) + (u < rate - int(rate)))
    return copies


def test_rows_and_shards_against_brute_force(spark, folder):
    want = brute(spark, folder)
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard_id", "group_bytes"]
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(x[0] for x in want) and len(want) > 60
    groups, shards = defaultdict(set), defaultdict(dict)
    for r in rows:
        groups[r["text"]].add(r["shard_id"])
        shards[r["shard_id"]][r["text"]] = r["group_bytes"]
    assert all(len(s) == 1 for s in groups.values())
    sizes = Counter(x[1] for x in want)
    assert sorted(sum(v.values()) for v in shards.values()) == one_by_one([len(t.encode()) * n for t, n in sizes.items()], SHARD_BYTES)


def test_stages_keep_the_columns_and_what_they_should(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontaminate", "mix_sources", "shard"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), folder[0]).count() == 0, name
    good = {x[0] for x in folder[1] if x[4]}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, folder[0]).collect()}
    assert good <= kept and not kept & {x[0] for x in folder[1] if not x[4]}


def test_stages_with_hard_rows_and_clashing_columns(spark, folder):
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    line = "The cat sat on the mat, and it slept well until the evening came and the rain was over.\n"
    rows = [(None, line * 3, "en", None, 1), (1, None, None, "s", 2), (2, "", "en", "s", 3), (3, line * 3, "en", "s", 4), (3, line * 3, "en", "s", 4), (4, line * 3000, "en", "s", 5)]
    extra = [f"1 as {c}" for c in ("key", "id", "near_id", "near_row", "winnow_text", "mix_source", "mix_rate", "copy_no", "shard_key", "size", "rank", "part", "keep", "root")]
    docs = spark.createDataFrame(rows, shape).selectExpr("*", *extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns + (["shard_id", "group_bytes"] if name == "shard" else []), name
        assert (0 < out.count() <= 6 or name == "mix_sources") and stage(spark, docs.limit(0), folder[0]).count() == 0, name
    assert corpus_pipeline.keep_one_of_copies(spark, docs, folder[0]).count() == 4  # of 3 one row, and 4 is a copy of it
    twice = docs.selectExpr(*[c for c in docs.columns if c not in ("part", "root")], "1 shard_id")
    assert corpus_pipeline.shard(spark, twice, folder[0]).columns.count("shard_id") == 1
