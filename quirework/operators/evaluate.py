"""Retrieval metrics over rankings (query_id, ranked array<string>, expected array<string>), as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.providers import Provider
from quirework.functions.text import basename, parent_id
from quirework.operators.retrieval import bounded_context, contexts, nearest, retrieve
from quirework.sources.records import embedded

RERANK_SOURCES = ("external", "llm_fallback", "llm", "vector")


def reciprocal_rank(ranked: Column, expected: Column) -> Column:
    """1 over the place of the first item that is expected; 0 without any."""
    places = F.filter(F.transform(ranked, lambda x, i: F.when(F.array_contains(expected, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0)


def _mean(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def baseline_metrics(rankings: DataFrame) -> DataFrame:
    """(recall_at_5, mrr): any expected item among the first five; ranks over the whole list."""
    hit = F.arrays_overlap(F.slice("ranked", 1, 5), F.col("expected")).cast("double")
    return rankings.agg(_mean(F.coalesce(hit, F.lit(0.0))).alias("recall_at_5"), _mean(reciprocal_rank(F.col("ranked"), F.col("expected"))).alias("mrr"))


def runtime_metrics(rankings: DataFrame) -> DataFrame:
    """(recall_at_2, mrr, all_expected_sources_rate, average_retrieval_latency_seconds, average_graph_edges) of rankings that
    also have returned_sources, expected_sources, latency and graph_edges: the share of expected items among the first two."""
    two, want = F.array_distinct(F.slice("ranked", 1, 2)), F.array_distinct("expected")
    recall = F.when(F.size(want) > 0, F.size(F.array_intersect(two, want)) / F.size(want)).otherwise(0.0)
    have = F.transform(F.filter("returned_sources", lambda s: s != ""), basename)
    found = ((F.size("expected_sources") > 0) & (F.size(F.array_except("expected_sources", have)) == 0)).cast("double")
    return rankings.agg(_mean(recall).alias("recall_at_2"), _mean(reciprocal_rank(F.slice("ranked", 1, 2), F.col("expected"))).alias("mrr"), _mean(found).alias("all_expected_sources_rate"), _mean(F.col("latency")).alias("average_retrieval_latency_seconds"), _mean(F.col("graph_edges")).alias("average_graph_edges"))


def rerank_rates(rows: DataFrame) -> DataFrame:
    """(rerank_source, rate) over the fixed domain, 0 where there is none."""
    domain = rows.sparkSession.createDataFrame([(s,) for s in RERANK_SOURCES], "rerank_source string")
    n = rows.groupBy("rerank_source").agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return domain.join(n, "rerank_source", "left").crossJoin(total).select("rerank_source", F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0).alias("rate"))


def expected_parents(cases: DataFrame) -> DataFrame:
    """(query_id, expected) of cases (query_id, expected array<struct<source,section>>)."""
    return cases.select("query_id", F.transform("expected", lambda e: parent_id(e["source"], e["section"])).alias("expected"))


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, delta): b less a, by name."""
    return a.withColumnRenamed("value", "was").join(b.withColumnRenamed("value", "now"), "metric").select("metric", (F.col("now") - F.col("was")).alias("delta"))


def match_titles(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(source, section, title): for each expected (source, section) the actual (source, title) that it means, or null.

    Equal letters and digits win. Otherwise at least 0.6 of its words, or one within the other; the best by the sum of both,
    then the greatest title.
    """
    def key(c: str) -> Column:
        return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")

    def words(c: str) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))

    e = expected.select("source", "section", key("section").alias("k"), words("section").alias("w"))
    a = actual.select("source", "title", key("title").alias("ak"), words("title").alias("aw"))
    rows = e.join(a, "source")
    overlap = F.size(F.array_intersect("w", "aw")) / F.size("w")
    within = (F.contains("ak", "k") | F.contains("k", "ak")).cast("double")
    rows = rows.withColumn("same", F.col("ak") == F.col("k")).withColumn("score", F.when(F.col("same"), 1e9).when((F.size("w") > 0) & ((overlap >= 0.6) | (within > 0)), overlap + within))
    w = Window.partitionBy("source", "section").orderBy(F.desc("score"), F.when(F.col("same"), F.col("title")), F.desc("title"))
    best = rows.filter("score is not null").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("source", "section", "title")
    return expected.select("source", "section").distinct().join(best, ["source", "section"], "left")


def remap_cases(cases: DataFrame, source_map: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, unresolved): cases (query_id, expected array<struct<source,section>>, target_file) in the names of a map (source,
    mapped) and the titles (source, title) stored of those; unresolved (query_id, source, section) are the expectations that
    have neither. A case without any expectation left is dropped; a target file that isn't in the map becomes ''."""
    each = cases.select("query_id", F.posexplode("expected").alias("nth", "e")).select("query_id", "nth", "e.source", "e.section")
    each = each.join(source_map, "source", "left")
    wanted = each.filter("mapped is not null").select(F.col("mapped").alias("source"), "section").distinct()
    found = match_titles(wanted, titles).select(F.col("source").alias("mapped"), "section", "title")
    each = each.join(found, ["mapped", "section"], "left")
    lost = each.filter("mapped is null or title is null").select("query_id", "source", "section")
    kept = each.filter("mapped is not null and title is not null").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("mapped").alias("source"), F.col("title").alias("section")))), lambda x: x.dropFields("nth")).alias("expected"))
    target = source_map.select(F.col("source").alias("target_file"), F.col("mapped").alias("mapped_target"))
    rest = cases.drop("expected").join(target, "target_file", "left")
    rest = rest.withColumn("target_file", F.when(F.coalesce("target_file", F.lit("")) == "", F.col("target_file")).otherwise(F.coalesce("mapped_target", F.lit("")))).drop("mapped_target")
    return rest.join(kept, "query_id"), lost


def evaluate_cases(cases: DataFrame, questions: DataFrame, sections: DataFrame, concepts: DataFrame, relations: DataFrame, provider: Provider, dim: int, limits: dict[str, int] | None = None) -> DataFrame:
    """(query_id, baseline, ranked, expected, returned_sources, expected_sources, rerank_source, graph_edges) of all cases
    (query_id, query, target_file, expected array<struct<source,section>>) in one plan.

    The baseline is the parents of the sections nearest to the query itself; sections and questions have vectors.
    """
    q = embedded(cases.select("query_id", "query", "target_file"), provider, dim, F.col("query"))
    base = nearest(q, sections.select(F.col("parent_id").alias("id"), "vector", "source"), 5).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("baseline"))
    found = retrieve(q, questions, sections.drop("vector"), provider, limits)
    shape = F.struct("place", "parent_id", "source", "rerank_source")
    got = found.groupBy("query_id").agg(F.array_sort(F.collect_list(shape)).alias("got"))
    scope = q.select("query_id", F.coalesce("target_file", F.lit("")).alias("scope"))
    edges = bounded_context(contexts(found.select("query_id", F.explode("anchor_nodes").alias("name")).join(scope, "query_id"), concepts, relations)).groupBy("query_id").agg(F.count("*").alias("graph_edges"))
    none = F.array().cast("array<string>")
    want = cases.select("query_id", F.transform("expected", lambda e: parent_id(e["source"], e["section"])).alias("expected"), F.array_distinct(F.transform("expected", lambda e: basename(e["source"]))).alias("expected_sources"))
    rows = want.join(base, "query_id", "left").join(got, "query_id", "left").join(edges, "query_id", "left")
    part = lambda c: F.coalesce(F.transform("got", lambda x: x[c]), none)
    return rows.select("query_id", F.coalesce("baseline", none).alias("baseline"), part("parent_id").alias("ranked"), "expected", part("source").alias("returned_sources"), "expected_sources", F.coalesce(F.get("got", F.lit(0))["rerank_source"], F.lit("vector")).alias("rerank_source"), F.coalesce("graph_edges", F.lit(0)).alias("graph_edges"))


def run_evaluation(results: DataFrame, seconds_a_query: float = 0.0) -> DataFrame:
    """(method, metric, value) of ``evaluate_cases``: the baseline's, those of the reranked questions, and their sources' rates."""
    def tall(df: DataFrame, method: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(method).alias("method"), F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")

    base = tall(baseline_metrics(results.select("query_id", F.col("baseline").alias("ranked"), "expected")), "parent_section_vector_baseline")
    own = tall(runtime_metrics(results.withColumn("latency", F.lit(float(seconds_a_query)))), "question_rerank")
    rates = rerank_rates(results).select(F.lit("rerank_source_rate").alias("method"), F.col("rerank_source").alias("metric"), F.col("rate").alias("value"))
    return base.unionByName(own).unionByName(rates)
