import uuid

import pytest
from pyspark.sql import functions as F

from quirework.functions import relations as R
from quirework.functions import text as T
from quirework.functions import vocab
from quirework.functions.markdown import display_blocks, normalize_markdown
from quirework.functions.providers import OfflineProvider, clamped, dedup_questions, loose_json
from quirework.functions.sql import register


def column(spark, values, expression, schema="v string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_vocabulary_is_whole():
    assert [len(x) for x in (vocab.CANONICAL, vocab.CANONICAL_OF, vocab.CUES, vocab.WORDINGS, vocab.LONE, vocab.EDGE, vocab.FEATURES, vocab.RESULTS)] == [18, 33, 105, 38, 109, 8, 49, 28]
    assert set(vocab.MEANINGS) == set(vocab.CANONICAL) == set(vocab.TRIGGERS) == {r for r, _ in vocab.WORDINGS}
    assert set(vocab.CANONICAL_OF.values()) <= set(vocab.CANONICAL)


def test_phrases_and_relations(spark):
    assert column(spark, ["  LoRA_x — Straße² É! ", None, "--"], T.normalized_phrase(F.col("v"))) == ["lora x strasse² é", "", ""]
    names = {"uses": "USES", "relies on": "USES", "extends": "BASED_ON", "tested_on": "EVALUATED_ON", "FINE_TUNES": "FINE_TUNES", "not a relation!": "", "???": "", "": "", None: "", "__Part--of__": "PART_OF", "USES\n": "USES", "9x": ""}
    assert column(spark, list(names), R.normalize_relation(F.col("v"))) == list(names.values())
    assert column(spark, ["USES", "USES\n", "uses", None, "A" * 65], R.is_well_formed(F.col("v"))) == [True, False, False, False, False]


def test_endpoints(spark):
    no = ["that", "where", "such", "little", "their", "intelligence that", "models such", "note", "but", "since", "", "the"]
    yes = ["residual connections", "positional encodings", "multi-head attention", "FFN", "layer", "self-attention"]
    assert column(spark, no + yes, R.is_concept_endpoint(F.col("v"))) == [False] * len(no) + [True] * len(yes)
    assert column(spark, ["residual connections", "100 million", "$5", "little bearing", "advantage", "heads"], R.is_feature(F.col("v"))) == [True, False, False, False, False, True]
    assert column(spark, ["state of the art", "a point", "BLEU score", "cat"], R.is_result(F.col("v"))) == [True, False, True, False]


QUOTES = [
    ("The system uses the technique.", "system", "USES", "technique", True),
    ("The technique is used by the system.", "system", "employs", "technique", True),
    ("The model is evaluated on a benchmark.", "model", "EVALUATED_ON", "benchmark", True),
    ("Our approach is based on self-attention.", "approach", "BASED_ON", "self-attention", True),
    ("Key components powering SLMs are quantization.", "quantization", "PART_OF", "SLMs", True),
    ("QLoRA fine-tunes LLaMA with adapters.", "QLoRA", "FINE_TUNES", "LLaMA", True),
    ("LLaMA is finetuned by QLoRA.", "QLoRA", "FINETUNED", "LLaMA", True),
    ("The model has residual connections.", "model", "HAS_FEATURE", "residual connections", True),
    ("An encoder is a layer within the network.", "encoder", "PART_OF", "network", True),
    ("The network contains an encoder.", "encoder", "PART_OF", "network", True),
    ("Attention and memory are related.", "memory", "RELATES_TO", "attention", True),
    ("Understanding graphs is required before understanding joins.", "graphs", "PREREQUISITE_OF", "joins", True),
    ("The system uses the technique.", "technique", "PART_OF", "system", False),
    ("The system uses the technique.", "technique", "USES", "system", False),
    ("QLoRA and LLaMA were seen.", "QLoRA", "FINE_TUNES", "LLaMA", False),
    ("The model has little bearing.", "model", "HAS_FEATURE", "little bearing", False),
    ("The model has seen 100 million.", "model", "HAS_FEATURE", "100 million", False),
    ("The model has an advantage.", "model", "HAS_FEATURE", "advantage", False),
    ("The method achieves a point.", "method", "ACHIEVES", "point", False),
    ("The method achieves high accuracy.", "method", "ACHIEVES", "high accuracy", True),
    ("The method requires less memory.", "method", "REQUIRES", "less memory", False),
    ("The system works. Uses of the technique.", "system", "USES", "technique", False),
    ("The system uses it. The technique is old.", "system", "USES", "technique", False),
    ("The subsystem uses the technique.", "system", "USES", "technique", False),
    ("", "a b", "USES", "c d", False),
    (None, "a b", "USES", "c d", False),
]


def test_quote_gate(spark):
    rows = [q[:4] for q in QUOTES]
    gate = R.quote_supports(*(F.col(c) for c in "qsrt"))
    assert column(spark, rows, gate, "q string, s string, r string, t string") == [q[4] for q in QUOTES]


def test_identity(spark):
    assert column(spark, [("demo_lora.md", "Method")], T.parent_id(F.col("a"), F.col("b")), "a string, b string") == ["4aa2d587f9e3aa3844e811ca996f82ec"]
    names = ["x", "section::é", ""] + [f"n{i}" for i in range(40)]
    assert column(spark, names, T.uuid5(F.col("v"))) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    assert column(spark, [("", None), ("a", "b")], T.locator(F.col("a"), F.col("b")), "a string, b string") == ["Unknown source::Unknown section", "a::b"]


def test_labels_and_bounds(spark):
    label = T.source_label(*(F.col(c) for c in "abcd"))
    assert column(spark, [("lora.pdf", "Method", 4, 5), ("l", "m", 4, 4), ("l", "m", None, 4), ("l", "m", 0, 4)], label, "a string, b string, c int, d int") == ["[lora.pdf — Method, p.4–5]", "[l — m, p.4]", "[l — m]", "[l — m]"]
    short, cut = column(spark, ["abc", "a" * 50 + "  " + "b" * 60], T.bounded_text(F.col("v"), 100))
    assert short == "abc" and len(cut) <= 100 and cut.startswith("aaa") and cut.endswith("bbb") and "left out" in cut
    assert column(spark, ["key abc at https://x.y/z?q " + "e" * 600], T.redacted(F.col("v"), "abc"))[0].startswith("key [redacted] at [url] eee")
    assert column(spark, ["one [A — b] two [C] three [A — b]"], T.known_citations(F.col("v"), F.array(F.lit("[A — b]")))) == ["one [A — b] two  three [A — b]"]
    assert column(spark, ['a"[b]\n(c)|<>{}\\'], T.mermaid_escape(F.col("v"))) == ["a#quot;#91;b#93; #40;c#41;#124;#60;#62;#123;#125;\\\\"]


@pytest.mark.parametrize(("line", "ok"), [("2 Method", True), ("2 Method:", True), ("2 BERT", True), ("2 GPT-4", True), ("5.1 Experimental setup", True), ("III Discussion", True), ("III. Discussion", True), ("Abstract", True), ("Related Work:", True), ("1 LBF16", False), ("2014 English-French results", False), ("2 , (5)", False), ("1 This ends.", False), ("2 Why?", False), ("some text", False)])
def test_headings(spark, line, ok):
    assert column(spark, [line], T.is_paper_heading(F.col("v"))) == [ok]


def test_markdown():
    assert normalize_markdown("x \\( a \\) y") == "x $a$ y" and normalize_markdown(None) == ""
    assert display_blocks("see\n\\[ x = 1 \\]\nend\n\\begin{align*}y\\end{align*}") == [("markdown", "see"), ("latex", "x = 1"), ("markdown", "end"), ("latex", "y")]
    assert normalize_markdown("text\n| a | b |\n| 1 | 2 |\n| 3 | 4 |") == "text\n\n| a | b |\n|---|---|\n| 1 | 2 |\n|---|---|\n| 3 | 4 |"
    assert normalize_markdown("| a | b |\n|---|---|\n| 1 | 2 |") == "| a | b |\n|---|---|\n| 1 | 2 |"


def test_providers():
    p = OfflineProvider(16)
    v = p.embed(["graph joins", "joins graph", "", None])
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-6 and not v[2].any() and not v[3].any()
    c = [{"parent_id": i, "question": q, "section_heading": "", "body_preview": ""} for i, q in (("a", "cats"), ("b", "joins of graphs"), ("c", "joins"))]
    assert p.rerank("joins graphs", c) == ["b", "c"]
    assert dedup_questions([("What is LoRA?", "1"), ("what is lora", "2"), ("??", "3")]) == [("What is LoRA?", "1")]
    assert loose_json("so: ```json\n{\"a\": 1}\n``` bye") == {"a": 1} == loose_json("x {\"a\": 1} trailing")
    with pytest.raises(ValueError):
        loose_json("none")
    assert [clamped(v, 25) for v in ("3", 0, -1, "x", None, 100)] == [3, 25, 25, 25, 25, 25]


def test_sql_functions(spark):
    assert "normalize_relation" in register(spark)
    row = spark.sql("select normalized_phrase('A_b') p, normalize_relation('relies on') r, normalize_relation('?') n, is_concept_endpoint('the') e, is_concept_endpoint('FFN') f, parent_id('demo_lora.md', 'Method') i, size(evidence_spans('One here. Two here.')) s, display_blocks('$$x$$')[0].kind k, normalize_markdown('\\\\\\\\(x\\\\\\\\)') m").first()
    assert tuple(row)[:8] == ("a b", "USES", "", False, True, "4aa2d587f9e3aa3844e811ca996f82ec", 2, "latex")
