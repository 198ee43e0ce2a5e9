DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, ids=None):
    rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else f"s{i % 2}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


#: Nulls, empty and blank texts, one very long, repeated rows, ties.
HARD = [None, "", "  \n", "one two three four", "one two three four", "é ß ✓ 漢字", "x" * 200_000, "word " * 40_000, ".", "a"]
