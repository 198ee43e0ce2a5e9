"""What the operators of this package share: column names, lineage cuts, streaming over sorted rows."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to write, compared without regard to case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    The setting of the session is used as it is. Where there is none, a session of one machine, as in tests, gets a
    temporary folder; on a cluster a folder of one machine would lose data, so it is an error.
    """
    sc = spark.sparkContext
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if not set_by and sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="quirework-"))
    return (set_by or sc.getCheckpointDir()).rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(text: Column) -> Column:
    """Lower-case words with single spaces between: runs of other than letters, marks and digits become one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " "))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of equal ``key`` (an integer column) out of batches sorted by it, many groups to a table.

    A group that spans batches is held until its end is seen; other groups are passed on batch by batch.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1])) if k[0] <= k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
