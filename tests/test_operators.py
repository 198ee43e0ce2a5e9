import random

import pytest
from pyspark.sql import functions as F

from quirework.functions.providers import OfflineProvider
from quirework.operators import compile as C
from quirework.operators import evaluate as E
from quirework.operators import graph as G
from quirework.operators import retrieval as V
from quirework.operators import sections as S
from quirework.operators.spans import MOST, evidence_spans, with_windows
from quirework.sources import documents as D
from quirework.sources import store as K
from quirework.streaming.ingest import EDGES, SECTIONS, ingest, start

LONG = "A sentence of plain prose that goes on for a while, as they do. " * 5


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Sections


def test_markdown_sections(spark):
    text = f"# Title\n\n# Abstract\n{LONG}\n### not a section\nmore\r\n## Method ##\n{LONG}"
    got = rows(S.split_markdown(spark.createDataFrame([("a.md", text), ("b.md", "just text"), ("c.md", " \n ")], "source string, content string")), "source", "seq_id")
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [("a.md", "Abstract", 0, 1, 1), ("a.md", "Method", 1, 1, 1), ("b.md", "Introduction", 0, 1, 1)]
    assert "### not a section\nmore" in got[0][7] and got[2][7] == "just text"


def test_stubs_go_into_the_next_section(spark):
    text = f"# Abstract\nshort\n# 1 Introduction\n{LONG}\n# Method\nalso short\n# 3 Results\n{LONG}\n# End\ntail"
    got = rows(S.split_markdown(spark.createDataFrame([("a", text)], "source string, content string")), "seq_id")
    assert [(r[1], r[2]) for r in got] == [("1 Introduction", 0), ("3 Results", 1), ("End", 2)]
    assert got[0][7].startswith("Abstract\nshort\nA sentence") and got[1][7].startswith("Method\nalso short\n")


def test_converted_sections(spark):
    text = f"# Some Title\nauthors\n# Abstract\n{LONG}\n# 1 Introduction\n{LONG}\n# stray prose heading\nafter it\n# References\n[1] gone\n# junk\nstill gone\n# A Appendix\n{LONG}"
    d = spark.createDataFrame([("a.md", text, "a.pdf", ["1-10"])], "source string, content string, origin_source string, page_ranges array<string>")
    s, report = S.split_converted(d)
    got = rows(s, "seq_id")
    assert [r[1] for r in got] == ["Abstract", "1 Introduction", "A Appendix"] and got[0][3] is None and got[0][5:7] == ("a.pdf", ["1-10"])
    assert "stray prose heading\nafter it" in got[1][7] and all("gone" not in r[7] and "authors" not in r[7] for r in got)
    assert rows(S.parse_report(s, report)) == [("a.md", 3, True)]


def test_paged_sections(spark):
    pages = ["A Title\nsomebody\nAbstract\nfirst\n1 LBF16\n2 , (5)\n", "more\n\n1 Introduction\nbody", "tail\n5 References\nlost", "A Appendix\nlost too"]
    s, report = S.split_pages(spark.createDataFrame([("p", pages)], "source string, pages array<string>"))
    assert [(r[1], r[2], r[3], r[4], r[7]) for r in rows(s, "seq_id")] == [("Abstract", 0, 1, 2, "first\n1 LBF16\n2 , (5)\nmore"), ("1 Introduction", 1, 2, 3, "body\ntail")]
    assert rows(report) == [("p", True)]


# Spans and relations


def test_spans():
    assert evidence_spans("") == evidence_spans(" \r\n ") == evidence_spans(None) == []
    assert [s[3] for s in evidence_spans("One is here. Two, e.g. this, is Fig. 2 there!  \"Three?\" End")] == ["One is here.", "Two, e.g. this, is Fig. 2 there!", "\"Three?\"", "End"]
    assert [s[3] for s in evidence_spans("first para\r\n\r\nsecond para")] == ["first para", "second para"]
    assert [s[3] for s in evidence_spans("# Head\n- one\n- two. and more\n| a |\n```")] == ["# Head", "- one", "- two. and more", "| a |", "```"]
    r = random.Random(1)
    for _ in range(100):
        text = "".join(r.choice(["word ", "x" * 550, ". ", "\n", "\n\n", "é😀 ", "e.g. ", "\t"]) for _ in range(r.randint(0, 120)))
        spans = evidence_spans(text)
        assert all(text[a:b] == s and 0 < len(s) <= MOST and s == s.strip() for _, a, b, s in spans)
        assert [s[0] for s in spans] == [f"e{i}" for i in range(len(spans))] and all(p[2] <= q[1] for p, q in zip(spans, spans[1:], strict=False))
        assert "".join("".join(s[3] for s in spans).split()) == "".join(text.split())


def scan(spark, text):
    spans = with_windows(spark.createDataFrame([("p", text)], "parent_id string, page_content string"))
    return [r[2:] for r in rows(C.local_candidates(spans), "idx")]


def test_local_scan(spark):
    assert scan(spark, "A compact update is a component of the adapter method.") == [("compact update", "PART_OF", "adapter method", "e0")]
    assert scan(spark, "The encoder is composed of a stack of N = 6 identical layers.") == [("stack of N = 6 identical layers", "PART_OF", "encoder", "e0")]
    assert scan(spark, "The encoder uses a stack. It is old.") == [("encoder", "USES", "stack", "e0"), ("encoder", "USES", "stack", "e0+e1")]
    assert scan(spark, "The encoder uses a stack.\n\nIt is old.") == [("encoder", "USES", "stack", "e0")]
    for text in ("The encoder does not matter.", "A and B were seen.", "The method requires less memory.", "Models such enable that."):
        assert scan(spark, text) == []


def test_union_and_gate(spark):
    shape = "parent_id string, idx int, source string, relation string, target string, evidence_id string"
    local = spark.createDataFrame([("p", 0, "A x", "USES", "B", "e0+e1"), ("p", 1, "C", "USES", "D", "e1")], shape)
    model = spark.createDataFrame([("p", 0, "E", "is based on", "F", "e2"), ("p", 1, "a X", "employs", "b", "e3"), ("p", 2, "c", "uses", "d", "e9"), ("p", 3, "", "uses", "d", "e9"), ("p", 4, "G", "?", "d", "e9")], shape)
    assert [r[1:] for r in rows(C.union_candidates(local, model), "idx")] == [(0, "A x", "USES", "B", "e0+e1", True), (1, "C", "USES", "D", "e1", True), (2, "E", "IS_BASED_ON", "F", "e2", False)]
    assert rows(C.union_candidates(local, spark.createDataFrame([("q", i, f"S{i}", "USES", "T", "e0") for i in range(15)], shape)).groupBy("parent_id").count(), "parent_id") == [("p", 2), ("q", 12)]


def test_compile_section(spark):
    text = "The adapter method uses a compact update. It is old. " + LONG
    many = " ".join(f"Part{i} is a component of the system." for i in range(14)) + LONG
    s = spark.createDataFrame([("p", "a.md", "Method", 0, text), ("q", "a.md", "Thin", 1, "The thing uses a tool."), ("r", "a.md", "Many", 2, many)], "parent_id string, source string, section string, seq_id int, page_content string")
    out = C.compile_relations(s)
    edges = rows(out["edges"].select("parent_id", "source", "relation", "target", "evidence_id"), "parent_id", "ord")
    assert edges[0] == ("p", "adapter method", "USES", "compact update", "e0") and [e[0] for e in edges].count("r") == 12 and not [e for e in edges if e[0] == "q"]
    assert dict(rows(out["rejections"])) == dict.fromkeys(C.REASONS, 0)
    audit = rows(C.audit(out["edges"], s))
    assert len(audit) == 10 and audit[0][3:5] == ("a.md::Method", "e0") and all(len(a[5]) <= 120 for a in audit)


def test_ground_plan(spark):
    shape = "parent_id string, main_entities array<string>, learning_roadmap array<struct<title:string,content_focus:string,concepts:array<string>>>, nodes array<struct<name:string,description:string>>, edges array<struct<source:string,target:string>>"
    plan = [("p", ["LoRA", "PEFT", "lora", " Low-Rank Matrix "], [("t", "f", ["PEFT", "LoRA"]), (" ", "f", [])], [("PEFT", ""), ("LoRA", "d")], [("LoRA", "PEFT"), ("LoRA", "low-rank matrix")])]
    s = spark.createDataFrame([("p", "LoRA uses a low-rank matrix.")], "parent_id string, page_content string")
    g = C.ground_plan(spark.createDataFrame(plan, shape), s).first()
    assert g["main_entities"] == ["LoRA", "Low-Rank Matrix"] and [tuple(x) for x in g["learning_roadmap"]] == [("t", "f", ["LoRA"])]
    assert [tuple(x) for x in g["nodes"]] == [("LoRA", "d")] and [tuple(x) for x in g["edges"]] == [("LoRA", "low-rank matrix")]
    a = spark.range(1).select(C.anchors(F.array(F.lit("LoRA"), F.lit(" ")), F.array(F.lit("Low-Rank Matrix")), F.array(F.lit("LoRA"), F.lit("low-rank matrix")))).first()[0]
    assert a == ["LoRA", "Low-Rank Matrix", "low-rank matrix"]


# Graph

CON, REL = "id string, description string, is_main boolean, source_locators array<string>", "source string, type string, target string, source_locators array<string>"


def graph(spark, edges, more=()):
    ids = sorted({x for e in edges for x in (e[0], e[2])} | set(more))
    return spark.createDataFrame([(i, f"d{i}", False, ["s::1"]) for i in ids], CON), spark.createDataFrame([(a, t, b, loc) for a, t, b, loc in edges], REL)


def test_merge(spark):
    c = G.merge_concepts(spark.createDataFrame([(1, "LoRA", "first", False, "a::1"), (2, "LoRA", "", True, "b::1"), (3, " LoRA ", "last", False, "a::1"), (4, "lora", None, None, "a::1"), (5, " ", "x", True, "a::1")], "ord long, id string, description string, is_main boolean, locator string"))
    assert rows(c, "id") == [("LoRA", "last", True, ["a::1", "b::1"]), ("lora", "", False, ["a::1"])]
    r = G.merge_relations(spark.createDataFrame([(1, "A", "extends", "B", "b::1"), (2, "A", "BASED_ON", "B", "a::1"), (3, "A", "?", "B", "a::1"), (4, "", "uses", "B", "a::1")], "ord long, source string, type string, target string, locator string"))
    assert rows(r) == [("A", "BASED_ON", "B", ["b::1", "a::1"])]


def test_remove_locator(spark):
    c = spark.createDataFrame([("A", "", True, ["a::1", "b::1"]), ("B", "", False, ["a::1"]), ("C", "", False, ["b::1"]), ("D", "", False, None)], CON)
    r = spark.createDataFrame([("A", "USES", "C", ["a::1", "b::1"]), ("A", "USES", "B", ["b::1"]), ("C", "USES", "A", ["a::1"]), ("D", "USES", "C", None)], REL)
    c2, r2 = G.remove_locator(c, r, "a::1")
    assert [x[0] for x in rows(c2, "id")] == ["A", "C", "D"] and rows(r2, "source") == [("A", "USES", "C", ["b::1"]), ("D", "USES", "C", None)]


def test_traversals_equal_trails(spark):
    r = random.Random(4)
    for _ in range(3):
        edges = list({(f"n{r.randint(0, 12)}", r.choice("XY"), f"n{r.randint(0, 12)}"): [r.choice(["s::1", "s-extra::1"])] for _ in range(14)}.items())
        edges = [(*k, v) for k, v in edges]
        c, rel = graph(spark, edges)
        names = spark.createDataFrame([("n1",), ("n2",), ("",), ("zz",)], "name string")
        at = {"n1", "n2"}
        near = at | {b for a, _, b, _ in edges if a in at} | {a for a, _, b, _ in edges if b in at}
        for mode, want in (("semi_search", [e for e in edges if e[2] in at]), ("one_hop", [e for e in edges if e[0] in at or e[2] in at]), ("search", [e for e in edges if e[0] in near or e[2] in near])):
            for source in ("", "s"):
                got = [(x[0], x[2], x[3]) for x in rows(G.graph_context(c, rel, names, mode, source))]
                assert got == sorted((a, t, b) for a, t, b, loc in want if not source or loc == ["s::1"]), mode


def test_subgraph_and_visual(spark):
    p = "PREREQUISITE_OF"
    c, rel = graph(spark, [("a", p, "b", ["x::1"]), ("b", p, "c", ["x::1"]), ("c", p, "d", ["y::1"]), ("d", p, "b", None), ("c", "RELATES_TO", "z", ["y::2"])])
    assert tuple(G.concept_subgraph(c, rel, "c", 2).first()) == (["a", "b", "d"], ["b", "d"], ["z"])
    assert tuple(G.concept_subgraph(c, rel, "c", 9).first())[0] == ["a", "b", "c", "d"]  # a cycle gives the target itself
    assert tuple(G.concept_subgraph(c, rel, "none").first()) == ([], [], [])
    assert [x[:3] for x in rows(G.visual_graph(c, rel, source="x")[1])] == [("a", p, "b"), ("b", p, "c")]
    assert [x[0] for x in rows(G.visual_graph(c, rel, locator="s::1")[1])] == ["d"]
    assert rows(G.source_counts(c, rel, ["s", "x", "none"]), "source") == [("none", 0, 0), ("s", 5, 0), ("x", 0, 2)]


def test_rendering(spark):
    e = spark.createDataFrame([(1, "A [x]", "USES", "B"), (2, "B", "IS", "A [x]"), (3, "", "q", "")], "ord int, source string, label string, target string")
    n = spark.createDataFrame([(1, "B"), (2, "C"), (3, "")], "ord int, id string")
    assert G.mermaid(e, n).first()[0] == 'graph LR\n  n0["A #91;x#93;"] -->|USES| n1["B"]\n  n1["B"] -->|IS| n0["A #91;x#93;"]\n  n2["C"]'
    assert rows(G.relation_lines(e.withColumn("relation", F.lit("")).limit(1))) == [("A [x] —USES→ B",)]
    u = G.unique_edges(spark.createDataFrame([(" A", "", "L", "B"), ("A", "L", "", "B "), ("A", None, None, "B"), ("", "x", "", "B")], "source string, relation string, label string, target string"))
    assert rows(u) == [("A", "L", "B")]


# Retrieval and evaluation


@pytest.mark.parametrize(("vector", "reranked", "want"), [("vrt", "r", "rv"), ("vst", "ts", "tv"), ("vrs", "vvrs", "vr"), ("vr", "", "vr"), ("vr", "xy", "vr"), ("v", "v", "v"), ("vr", None, "vr")])
def test_fusion(spark, vector, reranked, want):
    d = spark.createDataFrame([(list(vector), list(reranked) if reranked is not None else None)], "v array<string>, r array<string>")
    assert d.select(V.fuse(F.col("v"), F.col("r"))).first()[0] == list(want)
    assert d.select(V.rerank_source(F.col("v"), F.col("r"), F.lit("llm"))).first()[0] == ("llm" if set(reranked or "") & set(vector) else "vector")


def test_collapse_and_order(spark):
    hits = spark.createDataFrame([(1, p, i) for i, p in enumerate(["a", "", "a", "b", None, "c", "d", "e", "f"])], "query_id int, parent_id string, rank int")
    got = V.collapse(hits)
    assert [(r["parent_id"], r["place"]) for r in got.orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5)]
    scores = spark.createDataFrame([(1, "a", 1, 0.1), (1, "b", 2, 0.9), (2, "c", 1, float("nan")), (2, "d", 2, 1.0)], "query_id int, parent_id string, place int, score double")
    named = V.ranked_scores(scores)
    assert rows(named, "named") == [(1, "b", 1), (1, "a", 2)]
    assert [r["parent_id"] for r in V.preordered(got, named.filter("parent_id = 'b'")).orderBy("place").collect()] == ["b", "a", "c", "d", "e"]


def small_corpus(spark):
    p = OfflineProvider(32)
    texts = {"a": "Joins combine tables by keys. They shuffle rows.", "b": "Windows rank rows of a partition.", "c": "Graphs have nodes and edges."}
    s = spark.createDataFrame([(k, "x.md", k.upper(), 1, 2, v, [k.upper()]) for k, v in texts.items()], "parent_id string, source string, section string, page_start int, page_end int, page_content string, anchor_nodes array<string>")
    q = spark.createDataFrame([(f"{k}{i}", k, v, "know " + k, "x.md", [float(z) for z in p.embed([v])[0]]) for k, v in texts.items() for i in range(2)], "id string, parent_id string, question string, key_knowledge string, source string, vector array<float>")
    asked = [(1, "how do joins shuffle rows by keys", ""), (2, "edges of graphs", "x.md"), (3, "nothing", "other.md")]
    queries = spark.createDataFrame([(i, t, [float(z) for z in p.embed([t])[0]], f) for i, t, f in asked], "query_id int, query string, vector array<float>, target_file string")
    con = spark.createDataFrame([("A", "da", True, ["x.md::A"]), ("Z", "", False, ["x.md::A"])], CON)
    rel = spark.createDataFrame([("A", "USES", "Z", ["x.md::A"])], REL)
    return p, s, q, queries, con, rel


def test_ask(spark):
    p, s, q, queries, con, rel = small_corpus(spark)
    got = {r["query_id"]: r for r in V.ask(queries, q, s, con, rel, p).collect()}
    assert got[3]["answer"] == V.NO_SOURCE and got[3]["sources"] == []
    assert got[1]["sources"][0] == "[x.md — A, p.1–2]" and "Joins combine tables by keys. [x.md — A, p.1–2]" in got[1]["answer"]
    assert [tuple(x) for x in got[1]["graph_context"]] == [("A", "da", "USES", "Z", "")] and got[2]["sources"][0] == "[x.md — C, p.1–2]" and len(got[2]["sources"]) == 2


def test_teach(spark):
    _, s, _, _, con, rel = small_corpus(spark)
    road = spark.createDataFrame([("a", 1, "t1", "f", ["A"]), ("a", 0, "t0", "f", ["none"])], "parent_id string, seq_id int, title string, content_focus string, concepts array<string>")
    got = V.teach(s, road, con, rel).collect()
    assert [(r["title"], r["graph_context"] is None) for r in got] == [("t0", True), ("t1", False)]


def test_bounded_context(spark):
    r = spark.createDataFrame([(1, f"s{i:02}", "x" * 500, "R", "t", "") for i in range(20)] + [(2, f"s{i:02}", "", "R", "t", "") for i in range(20)], "query_id int, source string, source_desc string, relation string, target string, target_desc string")
    n = {r["query_id"]: r["count"] for r in V.bounded_context(r).groupBy("query_id").count().collect()}
    import json

    one = len(json.dumps({"source": "s00", "source_desc": "x" * 500, "relation": "R", "target": "t", "target_desc": ""}))
    assert n == {1: 4000 // one, 2: 12}


def test_metrics(spark):
    shape = "ranked array<string>, expected array<string>"
    m = E.baseline_metrics(spark.createDataFrame([(["x", "a"], ["a"]), (["x", "y", "z", "w", "b"], ["b"]), (["x"], ["c"])], shape)).first()
    assert abs(m[0] - 2 / 3) < 1e-12 and abs(m[1] - (1 / 2 + 1 / 5) / 3) < 1e-12
    assert tuple(E.baseline_metrics(spark.createDataFrame([], shape)).first()) == (0.0, 0.0)
    more = spark.createDataFrame([(["a", "b"], ["a", "c"], ["d/x.md"], ["x.md"], 1.0, 2), (["q", "a", "c"], ["a", "c"], ["x.md"], ["x.md", "y.md"], 3.0, 0), (["q"], [], [], [], 2.0, 1)], shape + ", returned_sources array<string>, expected_sources array<string>, latency double, graph_edges int")
    assert [round(x, 6) for x in E.runtime_metrics(more).first()] == [round(1 / 3, 6), 0.5, round(1 / 3, 6), 2.0, 1.0]
    assert dict(rows(E.rerank_rates(spark.createDataFrame([("llm",), ("vector",), ("llm",), ("llm",)], "rerank_source string")))) == {"external": 0.0, "llm_fallback": 0.0, "llm": 0.75, "vector": 0.25}
    assert rows(E.compare_metrics(spark.createDataFrame([("m", 0.5)], "metric string, value double"), spark.createDataFrame([("m", 0.25)], "metric string, value double"))) == [("m", -0.25)]
    cases = spark.createDataFrame([(1, [("demo_lora.md", "Method")])], "query_id int, expected array<struct<source:string,section:string>>")
    assert E.expected_parents(cases).first()[1] == ["4aa2d587f9e3aa3844e811ca996f82ec"]


def test_titles(spark):
    e = spark.createDataFrame([("s", "3 QL ORA Finetuning"), ("s", "Totally else"), ("s", "Results of tests")], "source string, section string")
    a = spark.createDataFrame([("s", "3 QLORA Finetuning"), ("s", "Test results"), ("s", "5 Results of the tests"), ("o", "Totally else")], "source string, title string")
    assert dict((r[1], r[2]) for r in rows(E.match_titles(e, a))) == {"3 QL ORA Finetuning": "3 QLORA Finetuning", "Totally else": None, "Results of tests": "5 Results of the tests"}


# Sources, store, stream


def test_manifests(spark):
    def chunk(a, b, state="done"):
        return (f"{a}-{b}", a, b, "t", state, None)

    good = [chunk(1, 3), chunk(4, 4)]
    cases = [("a.pdf", 4, True, good, None), ("a.pdf", 4, False, good, "incomplete"), ("a.pdf", 4, None, good, "incomplete"), ("a.pdf", 4, True, [], "no chunks"), ("a.pdf", 0, True, good, "page count"), ("a.pdf", 4, True, [chunk(1, 3), chunk(4, 4, "failed")], "unfinished"), ("a.pdf", 4, True, [chunk(1, 3)], "doesn't cover the pages"), ("a.pdf", 4, True, [chunk(1, 2), chunk(4, 4)], "doesn't cover the pages"), (" ", 4, True, good, "no source")]
    m = spark.createDataFrame([(i, s, n, c, None, k, None) for i, (s, n, c, k, _) in enumerate(cases)], "i int, " + D.MANIFEST)
    assert [r["problem"] for r in D.manifest_problem(m).orderBy("i").collect()] == [c[4] for c in cases]
    docs = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "source string, content string")
    got = D.with_manifests(docs, m.withColumn("stem", F.when(F.col("i") == 0, "a").otherwise("b")).filter("i < 2"))
    assert rows(got, "source") == [("a.md", "x", "a.pdf", ["1-3", "4-4"]), ("b.md", "y", None, None)]


def test_page_ranges_and_chunks(spark):
    p = spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "source string, page_count int")
    assert rows(D.page_ranges(p), "source", "start_page") == [("a", 1, 10), ("a", 11, 20), ("a", 21, 25), ("c", 1, 10)]
    with pytest.raises(ValueError):
        D.page_ranges(p, 21)
    c = spark.createDataFrame([("a", 11, "done", "two"), ("a", 1, "done", "one"), ("b", 1, "failed", None), ("b", 11, "done", "rest")], "source string, start_page int, state string, markdown string")
    assert rows(D.merge_chunks(c), "source") == [("a", "one\n\ntwo", True), ("b", "rest", False)]


def test_last_heading_wins(spark):
    s = spark.createDataFrame([("p", 0, "old"), ("p", 1, "new"), ("q", 0, "only")], "parent_id string, seq_id int, page_content string")
    assert [r[2] for r in rows(D.last_of_parent(s), "parent_id")] == ["new", "only"]


def test_store(spark, tmp_path):
    st = K.SnapshotStore(spark, str(tmp_path / "store"))
    assert st.version() == 0 and st.read("t", "a int").count() == 0
    st.commit({"t": spark.createDataFrame([(1,)], "a int")})
    st.commit({"t": st.read("t", "a int").union(spark.createDataFrame([(2,)], "a int"))})
    assert st.version() == 2 and rows(st.read("t", "a int"), "a") == [(1,), (2,)]
    with pytest.raises(ValueError):
        K.check_dimension(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vector array<float>"), 2)


def test_ingest_is_incremental(spark, tmp_path):
    st = K.SnapshotStore(spark, str(tmp_path / "store"))
    text = f"# Method\nThe adapter method uses a compact update. {LONG}\n# Results\n{LONG}"
    docs = spark.createDataFrame([("a.md", text)], "source string, content string")
    assert ingest(docs, st) == 2 and ingest(docs, st) == 0
    changed = spark.createDataFrame([("a.md", text.replace("compact", "small"))], "source string, content string")
    assert ingest(changed, st) == 1 and st.version() == 2
    assert [r[0] for r in rows(st.read("sections", SECTIONS).select("section"), "section")] == ["Method", "Results"]
    assert rows(st.read("edges", EDGES).select("source", "relation", "target")) == [("adapter method", "USES", "small update")]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text(f"# Method\nThe adapter method uses a compact update. {LONG}")
    st = K.SnapshotStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        q = start(spark, str(src), st, str(tmp_path / "check"))
        q.awaitTermination(120)
        (src / "b.md").write_text(f"# Results\n{LONG}")
    assert sorted(r[0] for r in st.read("sections", SECTIONS).select("source").collect()) == ["a.md", "b.md"]
    assert rows(D.read_markdown(spark, str(src / "a.md")).select("source")) == [("a.md",)]
