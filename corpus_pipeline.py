"""From raw documents to training shards: stages, each of which calls one operator and is written out before the next.

In all stages extra columns are kept, whatever their names, long texts count whole, and no documents give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import jaccard_join, mixing, quality_rules, sharding, winnowing
from quirework.llm.common import shared_folder, table
from quirework.llm.queries import MIX_SEED, SHARD_BYTES, WEIGHTS, quality_field

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose share of content lines is high enough; rows are judged one by one, by their text.

    Null, empty and blank texts have no content and go. Null ids and repeated rows are judged like others. Ties: a share at
    the threshold is enough.
    """
    return quality_rules.filter_docs(docs, quality_field(spark, sf_dir))


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id.

    Rows without an id and texts without a word stay. Repeated rows (one id): one stays. Ties: a pair at the threshold is one
    of copies.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that share no passage with the benchmark.

    Rows are judged by their text: null ids and repeated rows like others; null and empty texts stay.
    """
    return winnowing.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources; the copies are repeated rows.

    A null source is a source; null ids have a coin of their text; null and empty texts have no tokens, but are emitted like
    others of their source; repeated rows have the same coin.
    """
    return mixing.mix(docs, WEIGHTS, seed=MIX_SEED, copy_col=None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents with the shard of each, shard_id, and group_bytes, which replace columns of these names.

    Null and empty texts have size 0. Equal texts and repeated rows share a shard. Ties: by the hash of the text.
    """
    return sharding.shard(docs, SHARD_BYTES)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", keep_one_of_copies),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL can't express the labelling, the packing and the search for groups; tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is Parquet in the shared folder, read again, and removed
    when the next one is written. The last one stays, for the rows returned are read from it."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            at = spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        docs, before = spark.read.parquet(path), path
    return docs
