"""Evidence spans: verbatim slices of a section, with offsets in code points. Offsets need Python; it runs on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a span, at most; of the sections that are taken up together, about.
MOST, HELD = 500, 1 << 20
SPAN = "array<struct<id:string,start:int,end:int,text:string>>"
STRUCTURE = re.compile(r"\s*(?:```|\||#{1,6}\s|\d+\.\s|[*+-]\s)")
SENTENCE = re.compile("([.!?]+)([)\\]\"'’”]*)(?=\\s|\\Z)")
PARAGRAPH = re.compile(r"\n\s*\n")
BREAK = re.compile(r"\n\s*\n", re.ASCII)


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def _sentences(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    start = a
    for m in SENTENCE.finditer(text, a, b):
        if m.end() < b and not text[m.end()].isspace():
            continue
        word = re.search(r"[^\W\d_]+\Z", text[max(a, m.start() - 4) : m.start()])
        if m[1][0] == "." and word and len(word[0]) <= 3:
            continue  # an abbreviation
        yield start, m.end()
        start = m.end()
    yield start, b


def _pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A range in pieces of at most ``MOST``: cut at a paragraph, else a line, else white space, else anywhere."""
    a, b = _trim(text, a, b)
    while b - a > MOST:
        part = text[a : a + MOST]
        cut = max(part.rfind("\n\n"), part.rfind("\r\n\r\n"))
        if cut < 0:
            cut = max(part.rfind("\n"), part.rfind("\r\n"))
        if cut < 0:
            cut = next((i for i in range(MOST - 1, 0, -1) if part[i].isspace()), MOST)
        cut = cut if cut > 0 else MOST
        s, e = _trim(text, a, a + cut)
        if s < e:
            yield s, e
        a, b = _trim(text, a + cut, b)
    if a < b:
        yield a, b


def evidence_spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """(id, start, end, text): lines, if most lines are Markdown structure; else the sentences of each paragraph."""
    if not text or not text.strip():
        return []
    rows = [x for x in text.splitlines() if x.strip()]
    marked = sum(bool(STRUCTURE.match(x)) for x in rows)
    ranges: list[tuple[int, int]] = []
    if marked >= 2 and 2 * marked >= len(rows):
        ranges = [m.span() for m in re.finditer(r"[^\r\n]+", text)]
    else:
        at = 0
        for m in [*PARAGRAPH.finditer(text), None]:
            ranges += _sentences(text, at, m.start() if m else len(text))
            at = m.end() if m else at
    cut = [p for a, b in ranges for p in _pieces(text, a, b)]
    return [(f"e{i}", a, b, text[a:b]) for i, (a, b) in enumerate(cut)]


def evidence_spans_column(c: Column) -> Column:
    """``evidence_spans`` as an Arrow UDF."""

    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("id", "start", "end", "text"), s, strict=True)) for s in evidence_spans(t)])

    return F.pandas_udf(make, SPAN)(c)


def spans_and_windows(text: str | None) -> list[tuple[int, str, int, int, str, bool]]:
    """(ord, id, start, end, text, is_window): the spans, and two neighbours as one where no paragraph ends between them."""
    one = evidence_spans(text)
    both = [(i, f"{x[0]}+{y[0]}", x[1], y[2], text[x[1] : y[2]], True) for i, (x, y) in enumerate(zip(one, one[1:], strict=False)) if not BREAK.search(text, x[2], y[1])]
    return [(i, *x, False) for i, x in enumerate(one)] + both


COLUMNS = (("ord", T.IntegerType()), ("id", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("text", T.StringType()), ("is_window", T.BooleanType()))
KINDS = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())


def span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and windows of batches (parent_id, page_content), those of few sections at a time."""
    for b in batches:
        ids, texts = b.column(0), b.column(1)
        rows: list[tuple] = []
        of: list[int] = []
        held = 0
        for i in range(b.num_rows):
            found = spans_and_windows(text := texts[i].as_py())
            rows += found
            of += [i] * len(found)
            held += len(text or "") + 100
            if rows and (held > HELD or i + 1 == b.num_rows):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True))], ["parent_id", *(n for n, _ in COLUMNS)])
                rows, of, held = [], [], 0


def with_windows(sections: DataFrame) -> DataFrame:
    """(parent_id, ord, id, start, end, text, is_window): ``spans_and_windows`` of (parent_id, page_content), in one pass over
    the sections and without a shuffle. Sections are taken up by few, so that Python never holds many texts and their spans."""
    shape = T.StructType([T.StructField("parent_id", sections.schema["parent_id"].dataType), *(T.StructField(n, k) for n, k in COLUMNS)])
    return sections.select("parent_id", "page_content").mapInArrow(span_batches, shape)
