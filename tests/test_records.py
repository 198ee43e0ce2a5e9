"""Records, reports, contracts, evaluation and the store's races; most of their results are held against SQL by the queries."""

import json

import pytest
from pyspark.sql import functions as F

from quirework.functions.providers import OfflineProvider, capabilities, checked_questions, make_provider, retrieval_limits, self_test
from quirework.functions.text import parent_id
from quirework.operators import evaluate as E
from quirework.operators import reports as P
from quirework.operators.spans import spans_and_windows
from quirework.sources import documents as D
from quirework.sources import records as R
from quirework.sources.store import SnapshotStore


def test_paths_prefixes_and_providers():
    assert D.output_paths("out", "a") == ("out/a.md", "out/a.manifest.json")
    assert D.output_paths("out/b.MD", "a") == ("out/b.MD", "out/b.manifest.json")
    assert D.check_source_prefix("run1_") == "run1_"
    for bad in ("1run_", "run", "", "a-b_"):
        with pytest.raises(ValueError):
            D.check_source_prefix(bad)
    p = make_provider("offline", dim=8)
    assert self_test(p, 8) == [] and self_test(p, 9) == ["embed: shape"]
    assert capabilities(p)["embed"] and not capabilities(p)["external_scores"]
    assert checked_questions([("Is it?", "k"), ("is IT", "l"), (" ", "m")], 3) == [("Is it?", "k")]
    for bad in ("no list", [("a", "")] * 4):
        with pytest.raises(ValueError):
            checked_questions(bad, 3)
    assert retrieval_limits({"search_limit": 99, "max_candidate_parents": "3"}) == {"search_limit": 25, "max_candidate_parents": 3, "final_parent_limit": 2}


def test_windows_stop_at_paragraphs():
    text = "One works. Two works.\n\nThree works."
    assert [(x[1], x[4]) for x in spans_and_windows(text)] == [("e0", "One works."), ("e1", "Two works."), ("e2", "Three works."), ("e0+e1", "One works. Two works.")]
    assert spans_and_windows(None) == []


def test_two_writers(spark, tmp_path):
    one, two = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.commit({"t": spark.range(1)})
    two.version = lambda: 0  # it saw no version, and comes second
    with pytest.raises(RuntimeError):
        two.commit({"t": spark.range(5)})
    assert one.version() == 1 and one.read("t", "id long").count() == 1
    for n in (2, 3):
        one.commit({"t": spark.range(n)})
    assert one.read("t", "id long").count() == 3 and len(list((tmp_path / "s").glob("v*"))) == 2


def test_report_file(spark, tmp_path):
    P.write_report(spark, spark.range(2), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError):
        P.write_report(spark, spark.range(3), str(tmp_path / "q.json"), most=2)


def test_evaluation(spark):
    provider = OfflineProvider(16)
    names = ["adapter method", "window attention", "sparse index", "graph walk"]
    s = spark.createDataFrame([(f"{i}.md", n, f"The {n} is what this section is about. It says {n} twice.", [n]) for i, n in enumerate(names)], "source string, section string, page_content string, anchor_nodes array<string>")
    s = s.withColumn("parent_id", parent_id(F.col("source"), F.col("section"))).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1))
    s = R.embedded(s, provider, 16)
    q = R.embedded(s.select(F.concat("parent_id", F.lit("_q")).alias("id"), "parent_id", F.concat(F.lit("What is the "), "section", F.lit("?")).alias("question"), F.lit("").alias("key_knowledge"), "source"), provider, 16, F.col("question"))
    cases = spark.createDataFrame([(i, f"what is the {n}", "", [(f"{i}.md", n)]) for i, n in enumerate(names)], "query_id int, query string, target_file string, expected array<struct<source:string,section:string>>")
    con = spark.createDataFrame([(n, "") for n in names], "id string, description string")
    rel = spark.createDataFrame([(names[0], "USES", names[1], ["0.md::x"])], "source string, type string, target string, source_locators array<string>")
    got = E.evaluate_cases(cases, q, s, con, rel, provider, 16)
    value = {(r["method"], r["metric"]): r["value"] for r in E.run_evaluation(got).collect()}
    assert value["question_rerank", "recall_at_2"] == value["question_rerank", "mrr"] == value["parent_section_vector_baseline", "recall_at_5"] == 1.0
    assert value["rerank_source_rate", "llm"] == 1.0 and value["question_rerank", "average_graph_edges"] > 0
