"""What must not grow faster than its input: plans, parts and memory; and the results that it must leave as they are."""

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from quirework.functions import vocab
from quirework.functions.providers import OfflineProvider
from quirework.operators import compile as C
from quirework.operators import reports as P
from quirework.operators import retrieval as V
from quirework.operators import sections as S
from quirework.operators import spans as P2
from quirework.plans import more
from quirework.plans import queries as Q

SECTION = "parent_id string, source string, section string, seq_id int, page_content string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_gate_broadcasts_no_texts(spark):
    s = spark.range(3).selectExpr("cast(id as string) as parent_id", "'a' as source", "'s' as section", "1 as seq_id", "repeat('The net uses the adapter. ', 20) as page_content")
    edges = C.compile_relations(s)["edges"]
    assert "Broadcast" not in plan_of(edges)
    assert {tuple(r) for r in edges.select("source", "relation", "target").collect()} == {("net", "USES", "adapter")}


def test_the_patterns_of_the_local_scan(spark):
    words = sorted({*vocab._CLOSED, *vocab.CUES})
    slow, fast = re.compile("(?:" + "|".join(words) + r")\b"), re.compile(vocab.trie(words) + r"\b")
    for w in words:
        for x in (w, w[:-1], w + "s", w + "-x", w + " x", w[:1] + w):
            assert bool(slow.match(x)) == bool(fast.match(x)), x
    assert len(fast.pattern) < len(slow.pattern)
    for relation, wording in vocab.WORDINGS:
        assert re.search(vocab.landmark(wording), "x") is None, relation


def test_signs_in_a_text_are_no_pairs(spark):
    text = "\1a\2b\3 The net uses the adapter, and a \1probe\2 requires\tthe \3 stage. Net\1s use.\n The stage requires a probe."
    df = spark.createDataFrame([(text,)], "text string").select(Q.R.local_pairs(Q.F.col("text")).alias("p"))
    assert [tuple(p)[1:] for p in df.first()["p"]] == [("USES", "net", "adapter"), ("REQUIRES", "stage", "probe")]


def test_a_small_file_is_spread(spark, tmp_path):
    spark.range(50).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert Q._sentences(spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_vocabulary_of_many_sections_in_little_work(spark):
    """30,000 sections of one paper, all of the same two names: a list of all names before each would have 9 * 10^8."""
    s = spark.range(30_000).selectExpr("cast(id as string) as parent_id", "'a' as source", "cast(id as int) as seq_id", "array(concat('Net ', id % 2), '?') as anchor_nodes")
    s = s.unionByName(spark.createDataFrame([("x", None, None, ["B", "b"]), ("y", None, 1, ["C"])], "parent_id string, source string, seq_id int, anchor_nodes array<string>"))
    got = {r["parent_id"]: r["known"] for r in P.paper_vocabulary(s).filter("parent_id in ('0', '1', '29999', 'x', 'y')").collect()}
    assert got == {"0": [], "1": ["Net 0"], "29999": ["Net 0", "Net 1"], "x": [], "y": ["B"]}
    assert P.paper_vocabulary(s).selectExpr("sum(size(known))").first()[0] == 1 + 2 * 29_998 + 1


def test_triples_of_one_place_have_an_order(spark):
    shape = "parent_id string, idx int, source string, relation string, target string, evidence_id string"
    data = [("p", 0, s, "USES", t, "e0") for s in "dbca" for t in "zx"]
    for rows in (data, data[::-1], data[3:] + data[:3]):
        got = C.union_candidates(spark.createDataFrame(rows, shape), spark.createDataFrame([], shape)).orderBy("idx").collect()
        assert [(r["source"], r["target"]) for r in got] == sorted((r[2], r[4]) for r in data)


def test_exact_sections_of_the_whole_table(spark, tmp_path):
    x = spark.range(6000).selectExpr("id as p_partkey", "'n' as p_name", "'t' as p_type")
    x.write.parquet(f"{tmp_path}/part.parquet")
    got = more.exact_sections(spark, str(tmp_path))
    assert got.count() == 1200 and got.filter("parent_id > 4000").count() == 400


def brute(queries, points, k, digits):
    out = []
    for i, v, f in queries:
        found = []
        for j, w, s in points:
            if v is not None and w is not None and f in (None, "", s):
                n = float(np.linalg.norm(v) * np.linalg.norm(w))
                found.append((-round(float(np.dot(v, w)) / n, digits) + 0.0 if n else 0.0, j))
        out += [(i, j, -s, nth + 1) for nth, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("n, m, block", [(40, 300, 1 << 14), (300, 90, 16), (300, 5000, 1 << 14), (3, 4, 2), (5, 0, 9)])
def test_nearest_against_all_pairs(spark, n, m, block):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-3, 4, (max(n, m), 5))  # many ties, some zeros
    points = [(f"p{j}", None if j == 7 else [float(x) for x in vectors[j]], f"s{j % 3}") for j in range(m)]
    queries = [(i, None if i == 2 else [float(x) for x in vectors[i]], (None, "", "s1", "none")[i % 4]) for i in range(n)]
    q = spark.createDataFrame(queries, "query_id long, vector array<float>, target_file string")
    p = spark.createDataFrame(points, "id string, vector array<float>, source string")
    got = sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in V.nearest(q, p, 4, 6, block).collect())
    want = brute(queries, points, 4, 6)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-9)


def test_nearest_sends_points_once_a_block(spark):
    e = spark.range(5000).selectExpr("id as vec_id", "transform(sequence(1, 8), i -> cast(sin(id * i) as float)) as v")
    near = V.nearest(e.selectExpr("vec_id as query_id", "v as vector", "'' as target_file"), e.selectExpr("vec_id as id", "v as vector", "'' as source"), 3)
    plan = plan_of(near)
    assert "CoGroup" not in plan and plan.count("Exchange ") == 1 and "Window" not in plan
    assert near.count() == 15_000


def test_papers_are_split_within_their_rows(spark):
    long = "# 1 Method\n" + "A line of the method, which is long enough not to be a stub when there are some of it.\n" * 4
    heads = "".join(f"# 1.{i} Part\nshort\n" for i in range(1, 4001))
    docs = spark.createDataFrame([("a", f"# T\nwho\n# Abstract\n{long}# References\n[1] x\n", "o", ["1"]), ("b", heads, "o", ["1"]), ("c", None, "o", ["1"]), ("d", "no heading", "o", ["1"])], "source string, content string, origin_source string, page_ranges array<string>")
    sections, report = S.split_converted(docs)
    assert "Exchange" not in plan_of(sections) and "Exchange" not in plan_of(report) and "Exchange" not in plan_of(S.split_markdown(docs))
    got = [(r["source"], r["section"], r["seq_id"], len(r["page_content"])) for r in sections.orderBy("source").collect()]
    assert got[0][:3] == ("a", "1 Method", 0) and got[1] == ("b", "1.4000 Part", 0, len(heads) - 2 * 4000 - 1 - len("1.4000 Part\n"))
    assert sorted(map(tuple, report.collect())) == [("a", True), ("b", False)] and len(got) == 2
    assert "Broadcast" not in plan_of(S.parse_report(sections, report))


def test_spans_come_in_small_batches(spark):
    """A batch of sections with 8,400,000 characters, which come twice more in windows, goes in parts of a million or so."""
    text = "It works. So does that, as was seen. " * 500
    rows = [(str(i), None if i == 7 else text) for i in range(450)]
    parts = list(P2.span_batches([pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["parent_id", "page_content"])]))
    assert len(parts) > 6 and max(b.column("text").nbytes for b in parts) < 6_000_000
    assert sum(b.num_rows for b in parts) == 449 * 1999
    got = P2.with_windows(spark.createDataFrame(rows[5:9], "parent_id string, page_content string"))
    assert got.groupBy("parent_id").count().count() == 3 and got.filter("is_window").count() == 3 * 999
    assert got.filter("parent_id = '8' and id = 'e1'").select("ord", "start", "end", "text", "is_window").first()[:] == (1, 10, 36, "So does that, as was seen.", False)
    assert "ArrowEvalPython" not in plan_of(got)


def test_vectors_are_made_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(x):
        calls.add(len(x))
        return x.map(lambda t: [float(t), 1.0] if t % 3 else None)

    f = Q.F.pandas_udf(embed, "array<float>")
    points = spark.range(30).select("id", f("id").alias("vector"), Q.F.lit("").alias("source"))
    queries = spark.range(1).selectExpr("id as query_id", "array(1f, 1f) as vector", "'' as target_file")
    assert V.nearest(queries, points, 50).count() == 20 and calls.value == 30


def test_embeddings_are_the_counts_of_hashed_words():
    texts = ["One word, one WORD and ein Wort", "", None, "word " * 300]
    want = np.zeros((4, 7))
    for i, t in enumerate(texts):
        for w in (t or "").lower().replace(",", "").split():
            want[i, crc32(w.encode()) % 7] += 1 if crc32(w.encode()) >> 31 else -1
    n = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(OfflineProvider(7).embed(texts), want / np.where(n == 0, 1, n), atol=1e-6)


def test_contexts_are_bounded_before_they_are_sent(spark):
    rows = spark.range(3000).selectExpr("id % 2 as query_id", "concat('s', lpad(id, 4, '0')) as source", "'' as source_desc", "'USES' as relation", "'t' as target", "repeat('x', 200 + int(id)) as target_desc")
    out = V.bounded_context(rows)
    assert "WindowGroupLimit" in plan_of(out)
    got = [tuple(r) for r in out.orderBy("query_id", "ord").select("query_id", "source", "ord").collect()]
    assert got == [(q, f"s{2 * i + q:04}", i + 1) for q in (0, 1) for i in range(12)]
