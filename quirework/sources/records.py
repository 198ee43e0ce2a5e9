"""What is stored of compiled sections, as rows with ids of their own: anchors and roadmap steps in the curriculum, questions
beside it. A write replaces the rows of its ids; nothing else changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions.providers import Provider
from quirework.functions.text import content_hash, strip, uuid5

CURRICULUM = "id string, parent_id string, source string, section string, type string, seq_id int, title string, page_content string, content_hash string, content_focus string, concepts array<string>, anchor_nodes array<string>"
QUESTIONS = "id string, parent_id string, source string, type string, page_content string, key_knowledge string"
#: Sections that a scan returns, at most, by default.
SCAN_ROWS = 1000


def _shaped(df: DataFrame, shape: str) -> DataFrame:
    """The columns of a shape, with null for those that aren't there."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in shape.split(", "))])


def anchor_records(sections: DataFrame) -> DataFrame:
    """The anchor of each section (parent_id, source, section, seq_id, page_content and what else the curriculum has)."""
    own = F.coalesce("content_hash", content_hash(F.col("page_content"))) if "content_hash" in sections.columns else content_hash(F.col("page_content"))
    return _shaped(sections.withColumn("content_hash", own).withColumn("type", F.lit("section_anchor")).withColumn("id", uuid5(F.concat("parent_id", F.lit("_section")))), CURRICULUM)


def step_records(steps: DataFrame) -> DataFrame:
    """The roadmap steps (parent_id, source, seq_id, title, content_focus, concepts); a step without a number is number 0."""
    steps = steps.withColumn("seq_id", F.coalesce("seq_id", F.lit(0))).withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    name = F.concat("parent_id", F.lit("_step_"), F.col("seq_id").cast("string"))
    return _shaped(steps.withColumn("type", F.lit("roadmap_step")).withColumn("id", uuid5(name)), CURRICULUM)


def question_records(pairs: DataFrame) -> DataFrame:
    """The questions of (parent_id, source, qa array<struct<question,key_knowledge>>), numbered without the blank ones."""
    real = F.filter("qa", lambda x: strip(F.coalesce(x["question"], F.lit(""))) != "")
    rows = pairs.select("parent_id", "source", F.posexplode(real).alias("nth", "x"))
    name = F.concat("parent_id", F.lit("_q_"), F.col("nth").cast("string"))
    return _shaped(rows.select("parent_id", "source", F.lit("question").alias("type"), F.col("x.question").alias("page_content"), F.coalesce("x.key_knowledge", F.lit("")).alias("key_knowledge"), uuid5(name).alias("id")), QUESTIONS)


def distinct_questions(pairs: DataFrame) -> DataFrame:
    """Of (parent_id, nth, question, key_knowledge) the first of those of a section that differ in case and signs only."""
    key = F.trim(F.regexp_replace(F.lower("question"), r"[\W_]+", " "))
    first = pairs.withColumn("key", key).filter("key <> ''").groupBy("parent_id", "key").agg(F.min_by(F.struct("nth", "question", "key_knowledge"), "nth").alias("x"))
    return first.select("parent_id", "x.*")


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored rows but those of incoming ids, and the incoming ones."""
    return stored.join(incoming.select("id").distinct(), "id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def delete_parents(stored: DataFrame, parents: DataFrame) -> DataFrame:
    """The stored rows of other parents than these (parent_id)."""
    return stored.join(parents.select("parent_id").distinct(), "parent_id", "left_anti")


def embedded(records: DataFrame, provider: Provider, dim: int, text: Column | str | None = None) -> DataFrame:
    """``records`` with their vector: of the focus of a step, else of the content. A reply of another shape is an error."""

    @F.pandas_udf("array<float>")
    def vector(texts: pd.Series) -> pd.Series:
        out = np.asarray(provider.embed(texts.fillna("").tolist()), np.float32).reshape(-1, dim) if len(texts) else np.zeros((0, dim), np.float32)
        if len(out) != len(texts):
            raise RuntimeError("the embeddings don't match the texts")
        return pd.Series(list(out), dtype=object)

    if text is None:
        text = F.coalesce("content_focus", "page_content") if "content_focus" in records.columns else F.col("page_content")
    return records.withColumn("vector", vector(text))


def section_of(curriculum: DataFrame, parent_id: str) -> DataFrame:
    """The anchor of a parent: one row or none."""
    return curriculum.filter((F.col("type") == "section_anchor") & (F.col("parent_id") == parent_id)).limit(1)


def exact_sections(curriculum: DataFrame, source: str = "", section: str = "", most: int | None = SCAN_ROWS) -> DataFrame:
    """Anchors of a source, if one is named, and of a section, if one is named, in order of seq_id, then id: the first ``most``,
    or all."""
    out = curriculum.filter("type = 'section_anchor'")
    for column, value in (("source", source), ("section", section)):
        out = out.filter(F.col(column) == value) if value else out
    out = out.orderBy(F.coalesce("seq_id", F.lit(0)), "id")
    return out if most is None else out.limit(most)


def roadmap(curriculum: DataFrame, parent_id: str) -> DataFrame:
    """The steps of a parent, in order."""
    return curriculum.filter((F.col("type") == "roadmap_step") & (F.col("parent_id") == parent_id)).orderBy("seq_id")


def storage_counts(curriculum: DataFrame, questions: DataFrame, most_sections: int = SCAN_ROWS, most_questions: int = 10_000) -> DataFrame:
    """(source, sections, questions) of each source, counted up to what a scan returns."""
    s = curriculum.filter("type = 'section_anchor'").groupBy("source").agg(F.least(F.count("*"), F.lit(most_sections)).alias("sections"))
    q = questions.groupBy("source").agg(F.least(F.count("*"), F.lit(most_questions)).alias("questions"))
    return s.join(q, "source", "full").na.fill(0, ["sections", "questions"])


def paper_names(curriculum: DataFrame) -> DataFrame:
    """The sources that have sections, in order."""
    return curriculum.filter("type = 'section_anchor' and source <> ''").select("source").distinct().orderBy("source")
