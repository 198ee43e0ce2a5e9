"""From sections to verified relations: local candidates, their union with a model's, approvals, and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.relations import is_concept_endpoint, is_grounded, local_pairs, normalize_relation, quote_supports
from quirework.functions.text import normalized_phrase, strip
from quirework.operators.spans import with_windows

CAP, AUDIT_ROWS, PREVIEW, THIN = 12, 10, 120, 200
REASONS = ("invalid_approval", "duplicate_approval", "invalid_endpoint", "invalid_evidence_id", "span_grounding", "relation_mismatch")


def is_thin(text: Column) -> Column:
    """Too short for relations; the section is stored all the same."""
    return F.length(strip(text)) < THIN


def is_window_id(evidence_id: Column) -> Column:
    return F.contains(evidence_id, F.lit("+"))


def is_verbatim(section: Column, start: Column, end: Column, text: Column) -> Column:
    """Whether the text stands in the section at these offsets."""
    return F.coalesce((start >= 0) & (end <= F.length(section)) & (start < end) & (F.substring(section, start + 1, end - start) == text), F.lit(False))


def local_candidates(spans: DataFrame) -> DataFrame:
    """(parent_id, idx, source, relation, target, evidence_id): at most ``CAP`` of a section, those of single spans first."""
    hits = spans.select("parent_id", "is_window", "ord", "id", "text", F.posexplode(local_pairs(F.col("text"))).alias("n", "p")).select("parent_id", "is_window", "ord", "id", "text", "n", "p.*")
    s, t = normalized_phrase(F.col("source")), normalized_phrase(F.col("target"))
    ok = (s != "") & (t != "") & (s != t) & quote_supports(F.col("text"), F.col("source"), F.col("relation"), F.col("target"))
    hits = hits.withColumn("s", s).withColumn("t", t).filter(ok)
    first = Window.partitionBy("parent_id", "s", "relation", "t", "id").orderBy("n")
    hits = hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    order = Window.partitionBy("parent_id").orderBy("is_window", "ord", "n")
    return hits.withColumn("idx", F.row_number().over(order) - 1).filter(F.col("idx") < CAP).select("parent_id", "idx", "source", "relation", "target", F.col("id").alias("evidence_id"))


def union_candidates(local: DataFrame, model: DataFrame) -> DataFrame:
    """(parent_id, idx, source, relation, target, evidence_id, is_local): one row for each triple, at most ``CAP`` of a section.

    Of rows with one normalised triple, that with the best evidence stays (local before model, single span before
    window; of equals the first), at the place where the triple was first seen. Triples of one place are in the order of
    their normalised names and relations.
    """
    cols = ["parent_id", "idx", "source", "relation", "target", "evidence_id"]
    both = local.select(*cols, F.lit(True).alias("is_local")).unionByName(model.select(*cols, F.lit(False).alias("is_local")))
    both = both.withColumn("source", strip(F.coalesce("source", F.lit("")))).withColumn("target", strip(F.coalesce("target", F.lit("")))).withColumn("relation", normalize_relation(F.col("relation"))).withColumn("evidence_id", strip(F.coalesce("evidence_id", F.lit(""))))
    both = both.filter("source <> '' and target <> '' and relation <> ''").withColumn("seen", F.struct(~F.col("is_local"), F.col("idx")))
    single = (~is_window_id(F.col("evidence_id"))).cast("int")
    pref = F.when(F.col("is_local"), 2 + single).otherwise(single)
    s, t = normalized_phrase(F.col("source")), normalized_phrase(F.col("target"))
    w = Window.partitionBy("parent_id", s, "relation", t)
    best = both.withColumn("place", F.min("seen").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc(pref), "seen", "evidence_id", "source", "target"))).filter("nth = 1")
    order = Window.partitionBy("parent_id").orderBy("place", s, "relation", t)
    return best.withColumn("idx", F.row_number().over(order) - 1).filter(F.col("idx") < CAP).select(*cols, "is_local")


def judge(candidates: DataFrame, approvals: DataFrame, spans: DataFrame, sections: DataFrame) -> DataFrame:
    """Each approval (parent_id, idx) with its candidate and the first ``reason`` that speaks against it, null if none does.

    Joins are by sorting: what texts are made of may be far smaller than they are, and Spark would broadcast them by that.
    """
    times = Window.partitionBy("parent_id", "idx")
    a = approvals.select("parent_id", "idx", "seq").withColumn("times", F.count("*").over(times))
    c = candidates.withColumn("known", F.lit(True))
    last = spans.groupBy("parent_id", F.col("id").alias("evidence_id")).agg(F.max_by(F.struct("start", "end", "text"), F.col("ord")).alias("span"))
    rows = a.join(c.hint("merge"), ["parent_id", "idx"], "left").join(last.hint("merge"), ["parent_id", "evidence_id"], "left").join(sections.select("parent_id", "page_content").hint("merge"), "parent_id", "left")
    s, t = F.col("source"), F.col("target")
    rel, text = normalize_relation(F.col("relation")), F.col("span.text")
    whole, part = normalized_phrase(F.col("page_content")), normalized_phrase(text)
    blank = F.col("span").isNull() | (strip(F.coalesce(text, F.lit(""))) == "")
    bad_end = (normalized_phrase(s) == "") | (normalized_phrase(s) == normalized_phrase(t)) | ~is_concept_endpoint(s) | ~is_concept_endpoint(t) | ~is_grounded(s, whole) | ~is_grounded(t, whole)
    reason = (
        F.when(F.col("known").isNull(), "invalid_approval")
        .when(F.col("times") > 1, "duplicate_approval")
        .when(rel == "", "relation_mismatch")
        .when(blank, "invalid_evidence_id")
        .when(~is_verbatim(F.col("page_content"), F.col("span.start"), F.col("span.end"), text), "span_grounding")
        .when(bad_end, "invalid_endpoint")
        .when(~is_grounded(s, part) | ~is_grounded(t, part), "span_grounding")
        .when(~quote_supports(text, s, F.col("relation"), t), "relation_mismatch")
    )
    return rows.withColumn("reason", reason).withColumn("relation", rel).withColumn("span_text", text).drop("known", "times", "span", "page_content")


def rejections(judged: DataFrame) -> DataFrame:
    """(reason, n) over all six reasons."""
    domain = judged.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    n = judged.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return domain.join(n, "reason", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def retained(judged: DataFrame) -> DataFrame:
    """(parent_id, ord, source, relation, target, evidence_id, span_text): one edge for each triple, single spans preferred,
    in the order in which triples were first accepted."""
    ok = judged.filter("reason is null")
    w = Window.partitionBy("parent_id", normalized_phrase(F.col("source")), "relation", normalized_phrase(F.col("target")))
    ok = ok.withColumn("ord", F.min("seq").over(w)).withColumn("nth", F.row_number().over(w.orderBy(is_window_id(F.col("evidence_id")), "seq"))).filter("nth = 1")
    return ok.select("parent_id", "ord", "source", "relation", "target", "evidence_id", "span_text")


def audit(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """The first ``AUDIT_ROWS`` edges kept, in section order, with where they come from and how their evidence begins."""
    where = sections.select("parent_id", "seq_id", F.concat("source", F.lit("::"), "section").alias("locator"))
    rows = edges.join(where, "parent_id").orderBy("seq_id", "locator", "ord").limit(AUDIT_ROWS)
    return rows.select("source", "relation", "target", "locator", "evidence_id", F.left("span_text", F.lit(PREVIEW)).alias("evidence_preview"))


def ground_names(names: Column, normalized_text: Column) -> Column:
    """The names that stand in the text; of equal ones the first."""
    clean = F.filter(F.transform(names, strip), lambda n: is_grounded(n, normalized_text))
    keys = F.transform(clean, normalized_phrase)
    return F.filter(clean, lambda n, i: F.array_position(keys, normalized_phrase(n)) == i + 1)


def ground_plan(plan: DataFrame, sections: DataFrame) -> DataFrame:
    """A model's (parent_id, main_entities, learning_roadmap, nodes, edges) less what its section doesn't say."""
    rows = plan.join(sections.select("parent_id", normalized_phrase(F.col("page_content")).alias("whole")), "parent_id")
    whole = F.col("whole")
    steps = F.transform(F.filter("learning_roadmap", lambda s: (strip(F.coalesce(s["title"], F.lit(""))) != "") & (strip(F.coalesce(s["content_focus"], F.lit(""))) != "")), lambda s: s.withField("concepts", ground_names(s["concepts"], whole)))
    nodes = F.filter(F.transform("nodes", lambda n: n.withField("name", strip(n["name"]))), lambda n: is_grounded(n["name"], whole))
    edges = F.filter(F.transform("edges", lambda e: e.withField("source", strip(e["source"])).withField("target", strip(e["target"]))), lambda e: is_grounded(e["source"], whole) & is_grounded(e["target"], whole))
    return rows.select("parent_id", ground_names(F.col("main_entities"), whole).alias("main_entities"), steps.alias("learning_roadmap"), nodes.alias("nodes"), edges.alias("edges"))


def anchors(main_entities: Column, node_names: Column, edge_ends: Column) -> Column:
    """Names in order of first appearance, without blanks; case tells them apart."""
    return F.array_distinct(F.filter(F.transform(F.concat(main_entities, node_names, edge_ends), strip), lambda n: n != ""))


def compile_relations(sections: DataFrame, model_edges: DataFrame | None = None, approved_model: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidates, judged approvals and retained edges of sections (parent_id, source, section, seq_id, page_content).

    Thin sections have none. Local candidates are approved as they are; of a model's, those in ``approved_model``
    (parent_id, idx of the union).
    """
    thick = sections.filter(~is_thin(F.col("page_content")))
    spans = with_windows(thick)
    local = local_candidates(spans)
    shape = "parent_id string, idx int, source string, relation string, target string, evidence_id string"
    model = model_edges if model_edges is not None else sections.sparkSession.createDataFrame([], shape)
    both = union_candidates(local, model)
    own = both.filter("is_local").select("parent_id", "idx", F.col("idx").cast("long").alias("seq"))
    more = approved_model.select("parent_id", "idx", (F.monotonically_increasing_id() + CAP).alias("seq")) if approved_model is not None else None
    judged = judge(both, own.unionByName(more) if more is not None else own, spans, thick)
    return {"spans": spans, "candidates": both, "judged": judged, "edges": retained(judged), "rejections": rejections(judged)}
