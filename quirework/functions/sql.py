"""The functions for SQL: temporary SQL functions where an expression will do, Arrow UDFs where Python is needed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirework.functions import vocab
from quirework.functions.markdown import display_blocks, normalize_markdown
from quirework.operators.spans import SPAN, evidence_spans


def register(spark: SparkSession) -> list[str]:
    """Register normalized_phrase, normalize_relation, is_concept_endpoint, parent_id, content_hash, locator, evidence_spans,
    display_blocks and normalize_markdown; the names are returned. Nothing is kept but in this session."""
    phrase = r"trim(regexp_replace(replace(lower(coalesce(x, '')), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', ' '))"
    # as in the Column form: white space of any kind, and ends of texts, not of lines
    bare = r"regexp_replace(regexp_replace(coalesce(x, ''), '(?U)^\\s+', ''), '(?U)\\s+\\z', '')"
    raw = rf"regexp_replace(regexp_replace(regexp_replace(upper({bare}), '[ -]', '_'), '_+', '_'), '^_|_\\z', '')"
    names = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in vocab.CANONICAL_OF.items()) + ")"
    lone, edge = (", ".join(f"'{w}'" for w in words) for words in (vocab.LONE, vocab.EDGE))
    bodies = {
        "normalized_phrase(x STRING) RETURNS STRING": phrase,
        "normalize_relation(x STRING) RETURNS STRING": f"CASE WHEN {raw} RLIKE '^[A-Z][A-Z0-9_]{{0,63}}\\\\z' THEN coalesce(try_element_at({names}, {raw}), {raw}) ELSE '' END",
        "is_concept_endpoint(x STRING) RETURNS BOOLEAN": f"{phrase} <> '' AND {phrase} NOT IN ({lone}) AND element_at(split({phrase}, ' '), 1) NOT IN ({edge}) AND element_at(split({phrase}, ' '), -1) NOT IN ({edge})",
        "parent_id(source STRING, section STRING) RETURNS STRING": "md5(concat(source, '__', section))",
        "content_hash(x STRING) RETURNS STRING": "sha2(x, 256)",
        "locator(source STRING, section STRING) RETURNS STRING": "concat(coalesce(nullif(source, ''), 'Unknown source'), '::', coalesce(nullif(section, ''), 'Unknown section'))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("id", "start", "end", "text"), x, strict=True)) for x in evidence_spans(t)])

    def blocks(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"kind": k, "body": b} for k, b in display_blocks(t)])

    spark.udf.register("evidence_spans", F.pandas_udf(spans, SPAN))
    spark.udf.register("display_blocks", F.pandas_udf(blocks, "array<struct<kind:string,body:string>>"))
    spark.udf.register("normalize_markdown", F.pandas_udf(lambda s: s.map(normalize_markdown), "string"))
    return [h.split("(")[0] for h in bodies] + ["evidence_spans", "display_blocks", "normalize_markdown"]
