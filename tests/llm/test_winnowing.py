import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm.text import words
from quirework.llm.winnowing import Index, decontaminate, shared_spans, winnow
from tests.llm.helpers import DOCS, HARD, docs

ITEMS = "item_id long, text string"


def longest_runs(a, b, least):
    out = set()
    for d in range(-len(b), len(a) + 1):
        p = max(d, 0)
        while p < len(a) and p - d < len(b):
            n = 0
            while p + n < len(a) and p - d + n < len(b) and a[p + n] == b[p - d + n]:
                n += 1
            if n >= least:
                out.add((p, p - d, n))
            p += n + 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=4), st.lists(st.lists(st.sampled_from("abc"), max_size=15), max_size=3), st.integers(1, 4), st.integers(1, 4))
def test_every_long_span_and_no_other(texts, items, k, w):
    index = Index(list(range(len(items))), [" ".join(x) for x in items], k, w)
    got = set(index.spans(pa.array([" ".join(x) for x in texts], pa.string()), k + w - 1))
    assert got == {(i, j, *s) for i, a in enumerate(texts) for j, b in enumerate(items) for s in longest_runs(a, b, k + w - 1)}


def test_winnow_takes_the_rightmost_least():
    g = np.array([5, 3, 3, 9, 1, 7, 2, 8, 8], np.uint64)
    assert winnow(g, np.array([0, 6, 6, 7, 9]), 3).tolist() == [2, 4, 6, 8]


def test_words_agree_with_split():
    t = ["a bb a", "", "ccc"]
    h, at = words(pa.array(t))
    assert at.tolist() == [0, 3, 3, 4] and h[0] == h[2] and len(set(h.tolist())) == 3


def corpus(spark):
    r = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{x}" for x in r.integers(0, 5000, n))
    items = [word(30) for _ in range(12)]
    texts = [word(100) for _ in range(60)]
    for i in range(10):
        texts[i] = texts[i] + ". " + items[i].upper().replace(" ", ", ") + " " + word(20)
    texts[11] = texts[11] + " " + " ".join(items[3].split()[:11])
    texts[12] = texts[12] + " " + " ".join(items[3].split()[5:17])
    return docs(spark, texts), spark.createDataFrame(list(enumerate(items)), ITEMS)


def test_both_ways_give_the_planted_spans(spark):
    d, b = corpus(spark)
    a, c = (sorted(map(tuple, shared_spans(d, b, index_words=m).collect())) for m in (10**6, 0))
    assert a == c and [(x[0], x[1], x[4]) for x in a] == [*((i, i, 30) for i in range(10)), (12, 3, 12)]
    for m in (10**6, 0):
        assert {x["doc_id"] for x in decontaminate(d, b, index_words=m).collect()} == set(range(60)) - set(range(10)) - {12}


def test_hard_rows(spark):
    d = docs(spark, HARD + ["word " * 20, "word " * 20], ids=[0, 1, 2, 3, 3, 4, 5, 6, 7, None, None, 9]).selectExpr("*", "1 winnow_text", "2 item_id", "3 key")
    b = spark.createDataFrame([(1, None), (None, "word " * 13), (2, "word " * 13), (2, "word " * 13), (3, ""), (4, "x")], ITEMS).selectExpr("*", "5 doc_id")
    for m in (10**6, 0):
        out = {(x["doc_id"], x["item_id"]) for x in shared_spans(d, b, index_words=m).collect()}
        assert out == {(6, 2), (9, 2)}
        kept = decontaminate(d, b, index_words=m)
        assert kept.columns == d.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["0", "1", "2", "3", "3", "4", "5", "7", "None"]
        nothing = spark.createDataFrame([], DOCS)
        assert shared_spans(nothing, b, index_words=m).collect() == [] and decontaminate(nothing, b, index_words=m).collect() == []
    assert shared_spans(d, spark.createDataFrame([], ITEMS)).collect() == []
    assert decontaminate(d, spark.createDataFrame([], ITEMS)).count() == 12


def test_a_phrase_that_goes_on_and_on(spark):
    for phrase in (["w"], ["a", "b"], ["a", "b", "a"], [f"x{i}" for i in range(9)]):
        doc, item = (phrase * 300)[:257], (phrase * 90)[:71]
        index = Index([0], [" ".join(item)], 8, 5)
        got = [x[2:] for x in index.spans(pa.array([" ".join(doc)]), 12)]
        assert len(got) == len(set(got)) and set(got) == longest_runs(doc, item, 12)
        d, b = docs(spark, [" ".join(doc)]), spark.createDataFrame([(0, " ".join(item))], ITEMS)
        if len(phrase) < 3:
            assert {tuple(x)[2:] for x in shared_spans(d, b, index_words=0).collect()} == set(got)


def test_time_on_a_megabyte_of_one_word():
    index = Index([0, 1], ["word " * 400, "on and " * 300], 8, 5)
    for text in ("word " * 200_000, "on and " * 150_000):
        began = time.time()
        assert sum(1 for _ in index.spans(pa.array([text]), 12)) > 100_000
        assert time.time() - began < 10
