"""Reading documents: by suffix, with manifests for converted papers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.functions.text import basename

CHUNK = "struct<page_range:string,start_page:int,end_page:int,task_id:string,state:string,error:string>"
MANIFEST = f"source string, page_count int, complete boolean, partial boolean, chunks array<{CHUNK}>, markdown_path string"
BATCH, MOST_BATCH = 10, 20


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of Markdown files; any other file is an error."""
    df = spark.read.format("text").option("wholetext", True).load(path).select(basename(F.input_file_name()).alias("source"), F.col("value").alias("content"))
    ok = F.lower("source").rlike(r"\.(md|markdown)$")
    return df.select("source", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("not Markdown: "), "source"))).alias("content"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with the stem of their file's name, by which documents find them."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.withColumn("stem", F.regexp_replace(basename(F.col("_metadata.file_path")), r"(?i)(?:\.manifest)?\.json$", ""))


def manifest_problem(m: DataFrame) -> DataFrame:
    """The manifests with ``problem``: the first thing that forbids their use, or null. Chunks have to be done and to cover
    pages 1 to page_count, one after another; a path, if there is one, has to be of the manifest's own document."""
    c = F.col("chunks")
    chain = F.aggregate(c, F.lit(1), lambda at, x: F.when((at > 0) & (x["start_page"] == at) & (x["end_page"] >= at) & (x["end_page"] <= F.col("page_count")) & (x["page_range"] == F.concat(x["start_page"].cast("string"), F.lit("-"), x["end_page"].cast("string"))), x["end_page"] + 1).otherwise(F.lit(-1)))
    problem = (
        F.when(~F.coalesce("complete", F.lit(False)), "incomplete")
        .when(F.coalesce(F.size(c), F.lit(0)) < 1, "no chunks")
        .when(F.coalesce("page_count", F.lit(0)) < 1, "page count")
        .when(F.exists(c, lambda x: ~F.coalesce((x["state"] == "done") & (F.trim(x["page_range"]) != ""), F.lit(False))), "unfinished")
        .when(F.coalesce(chain, F.lit(-1)) != F.col("page_count") + 1, "doesn't cover the pages")
        .when(F.trim(F.coalesce("source", F.lit(""))) == "", "no source")
    )
    if "stem" in m.columns:
        other = F.regexp_replace(basename(F.col("markdown_path")), r"\.[^.]*$", "") != F.col("stem")
        problem = problem.when(F.coalesce(other, F.lit(False)), "belongs to another document")
    return m.withColumn("problem", problem)


def with_manifests(docs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Documents (source, content) with origin_source and page_ranges of the usable manifest of the same stem (stem), if any."""
    stem = F.regexp_replace("source", r"\.[^.]*$", "")
    good = manifest_problem(manifests).filter("problem is null").select("stem", F.col("source").alias("origin_source"), F.transform("chunks", lambda x: x["page_range"]).alias("page_ranges"))
    return docs.withColumn("stem", stem).join(good, "stem", "left").drop("stem")


def page_ranges(papers: DataFrame, batch: int = BATCH) -> DataFrame:
    """(source, start_page, end_page): contiguous ranges of at most ``batch`` pages of (source, page_count)."""
    if not 1 <= batch <= MOST_BATCH:
        raise ValueError(f"batch must be 1 to {MOST_BATCH}")
    rows = papers.filter("page_count >= 1").select("source", "page_count", F.explode(F.sequence(F.lit(1), F.col("page_count"), F.lit(batch))).alias("start_page"))
    return rows.select("source", "start_page", F.least(F.col("start_page") + batch - 1, F.col("page_count")).alias("end_page"))


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """(source, content, complete) of extracted chunks (source, start_page, state, markdown): those done, in page order."""
    done: Column = F.col("state") == "done"
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(done, F.struct("start_page", "markdown")))), lambda x: x["markdown"]), "\n\n")
    return chunks.groupBy("source").agg(text.alias("content"), (F.count(F.when(done, 1)) == F.count("*")).alias("complete"))


def last_of_parent(sections: DataFrame) -> DataFrame:
    """Of sections with one parent_id (equal headings), the one with the last seq_id."""
    w = Window.partitionBy("parent_id").orderBy(F.desc("seq_id"))
    return sections.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def output_paths(target: str, stem: str) -> tuple[str, str]:
    """Where a converted document and its manifest go: the target, if it is a Markdown file, or the stem in that folder."""
    base = re.sub(r"(?i)\.(?:md|markdown)$", "", target) if re.search(r"(?i)\.(?:md|markdown)$", target) else f"{target.rstrip('/')}/{stem}"
    return (target if base != f"{target.rstrip('/')}/{stem}" else f"{base}.md"), f"{base}.manifest.json"


def check_source_prefix(prefix: str) -> str:
    """A prefix for the sources of a run: a letter, then letters, digits and underscores, the last one an underscore."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*_", prefix):
        raise ValueError("a source prefix must be letters, digits and underscores, and end with an underscore")
    return prefix


def routed(files: DataFrame) -> DataFrame:
    """(source, route) of arriving files (source): Markdown is ingested, PDF is extracted first, and others are refused."""
    suffix = F.lower(F.regexp_extract("source", r"\.([^.]+)$", 1))
    return files.select("source", F.when(suffix.isin("md", "markdown"), "ingest").when(suffix == "pdf", "extract").otherwise("refuse").alias("route"))
