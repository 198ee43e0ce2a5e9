"""Mixing sources to target weights: each document is repeated so that sources reach their shares of the tokens."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import fresh, without

#: Runs of other than these are tokens.
BLANK = "[ \\t\\n\\r\\f]+"
SALTS = 32


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")).cast("bigint")


def rates(docs: DataFrame, weights: Mapping[str | None, float], default_weight: float = 1.0, budget: int | None = None) -> DataFrame:
    """(source, tokens, rate) of every source: rate = weight x budget / (sum of weights x tokens).

    ``budget`` is the number of tokens wanted in all, by default as many as there are. Sources without any token take
    no share and have rate 1: there is nothing to scale.
    """
    if not all(w >= 0 for w in [default_weight, *weights.values()]):
        raise ValueError("weights must not be negative")
    per = docs.groupBy("source").agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    weight = F.lit(float(default_weight))
    for k, w in weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(weight)
    per = per.withColumn("weight", weight)
    used = F.col("tokens") > 0
    total = per.agg(F.sum(F.when(used, F.col("weight"))).alias("all_weight"), F.sum("tokens").alias("all_tokens"))
    wanted = F.col("all_tokens").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when(~used, F.lit(1.0)).when(F.col("all_weight") == 0, F.lit(0.0)).otherwise(F.col("weight") * wanted / (F.col("all_weight") * F.col("tokens")))
    return per.crossJoin(F.broadcast(total)).select("source", "tokens", rate.alias("rate"))


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the document's id and the seed alone; without an id, from its text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit("none"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Mapping[str | None, float], default_weight: float = 1.0, budget: int | None = None, seed: int = 42, copy_col: str | None = "copy_no", broadcast_sources: int = 100_000) -> DataFrame:
    """Every document floor(rate) times, and once more if its coin falls below the rate's fraction.

    All columns of ``docs`` are kept; ``copy_col`` (1, 2, ...) is added, and replaces a column of that name, unless it
    is None. Tokens are runs of other than white space, counted over all texts.

    The table of rates has a row per source. Up to ``broadcast_sources`` rows, counted first, it goes to all
    executors and documents aren't shuffled; a larger one is joined on the source and a salt, so that a hot source
    is spread over ``SALTS`` partitions.

    Null source: a source of its own, weighted by the key None. Null or empty text: no tokens, but emitted like others
    of its source. Null id: the coin is of the text. Repeated rows: each is emitted, with the same coin. Long texts: counted whole. No rows: none.
    Extra columns are kept, whatever their names.
    """
    per = rates(docs, weights, default_weight, budget).select("source", "rate")
    few = per.limit(broadcast_sources + 1).collect()
    if copy_col:
        docs = without(docs, copy_col)
    key, rate, salt, n = fresh(docs, "mix_source"), fresh(docs, "mix_rate"), fresh(docs, "mix_salt"), copy_col or fresh(docs, "mix_copy")
    if len(few) <= broadcast_sources:
        small = docs.sparkSession.createDataFrame([(r["source"], r["rate"]) for r in few], f"`{key}` string, `{rate}` double")
        joined = docs.join(F.broadcast(small), docs["source"].eqNullSafe(small[key]))
    else:
        of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")
        wide = per.select(F.col("source").alias(key), F.col("rate").alias(rate), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        mine = docs.withColumn(fresh(docs, "mix_bucket"), of)
        joined = mine.join(wide, mine["source"].eqNullSafe(wide[key]) & (mine[mine.columns[-1]] == wide[salt]))
    extra = F.when(coin(F.col("doc_id"), F.col("text"), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    copies = (F.floor(rate) + extra).cast("int")
    out = joined.withColumn(n, copies).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([n] if copy_col else []))
