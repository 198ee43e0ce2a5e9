"""Counts and summaries of what an ingest did, and the paper's own vocabulary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions.text import normalized_phrase

COUNTERS = ("candidates", "verifier_approvals", "retained")


def counters(candidates: DataFrame, judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent_id, candidates, verifier_approvals, retained) of each section that has any."""
    each = [df.groupBy("parent_id").agg(F.count("*").alias(n)) for df, n in zip((candidates, judged, edges), COUNTERS, strict=True)]
    return each[0].join(each[1], "parent_id", "full").join(each[2], "parent_id", "full").na.fill(0, list(COUNTERS))


def ingest_summary(sections: DataFrame, counted: DataFrame, omitted: DataFrame, seconds: float) -> DataFrame:
    """One row of sections (parent_id, source, compiled boolean), ``counters`` and (source, bibliography_omitted)."""
    s = sections.agg(F.coalesce(F.sum(F.col("compiled").cast("int")), F.lit(0)).cast("long").alias("compiled"), F.coalesce(F.sum((~F.col("compiled")).cast("int")), F.lit(0)).cast("long").alias("up_to_date"))
    o = omitted.agg(F.coalesce(F.bool_or("bibliography_omitted"), F.lit(False)).alias("bibliography_omitted"))
    names = ("candidate_relationships", "approved_relationships", "retained_relationships")
    c = counted.agg(*[F.greatest(F.coalesce(F.sum(a), F.lit(0)), F.lit(0)).cast("long").alias(b) for a, b in zip(COUNTERS, names, strict=True)])
    return s.crossJoin(o).crossJoin(c).withColumn("elapsed_seconds", F.lit(float(seconds)))


def source_report(sections: DataFrame, counted: DataFrame) -> DataFrame:
    """(source, sections_compiled, sections_skipped, ingestion_run_status, the counters, graph_relationship_counts_scope) of
    sections (parent_id, source, section, seq_id, compiled) and ``counters``. A source of which nothing was compiled has
    counts that say nothing of this run, and is labelled so."""
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq_id", "section")))), lambda x: x["section"])
    rows = sections.join(counted, "parent_id", "left")
    out = rows.groupBy("source").agg(names(F.col("compiled")).alias("sections_compiled"), names(~F.col("compiled")).alias("sections_skipped"), *[F.greatest(F.coalesce(F.sum(F.when(F.col("compiled"), F.col(c))), F.lit(0)), F.lit(0)).cast("long").alias(c) for c in COUNTERS])
    some, other = F.size("sections_compiled") > 0, F.size("sections_skipped") > 0
    status = F.when(some & other, "partial").when(some, "compiled").otherwise("skipped_already_current")
    return out.withColumn("ingestion_run_status", status).withColumn("graph_relationship_counts_scope", F.when(some, "current_run").otherwise("not_current_run_skipped"))


def paper_vocabulary(sections: DataFrame) -> DataFrame:
    """(parent_id, source, seq_id, known): the names (anchor_nodes) accepted in earlier sections of the same paper, the first
    of those with one normalised form."""
    each = sections.select("source", "seq_id", F.posexplode("anchor_nodes").alias("nth", "name")).withColumn("key", normalized_phrase(F.col("name"))).filter("key <> ''")
    first = each.groupBy("source", "key").agg(F.min(F.struct("seq_id", "nth", "name")).alias("x"))
    # in order of their first section: as long as the paper's vocabulary, however many sections repeat it
    names = first.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list("x")).alias("names"))
    earlier = lambda n: F.coalesce(n["seq_id"] < F.col("seq_id"), n["seq_id"].isNull() & F.col("seq_id").isNotNull())
    known = F.transform(F.filter("names", earlier), lambda n: n["name"])
    return sections.join(names.hint("merge"), F.col("source").eqNullSafe(F.col("of")), "left").select("parent_id", "source", "seq_id", F.coalesce(known, F.array().cast("array<string>")).alias("known"))


def write_report(spark: SparkSession, rows: DataFrame, path: str, most: int = 100_000) -> None:
    """A report of at most ``most`` rows as one JSON file with an indent of 2, where Hadoop can write; larger results go by
    ``DataFrame.write.json``."""
    data = [json.loads(r[0]) for r in rows.limit(most + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    if len(data) > most:
        raise ValueError("too many rows for a report")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(json.dumps(data[0] if len(data) == 1 else data, indent=2, ensure_ascii=False).encode())
    finally:
        out.close()
