from itertools import product

import numpy as np
import pyarrow as pa

from quirework.llm.quality_rules import NAMES, Field, fit, gradient, label_lines, lines, training, viterbi
from tests.llm.helpers import DOCS, HARD, docs

CLEAN = "The cat sat on the mat, and it slept well.\nA second line of plain prose ends here.\n"
PROSE = ["The cat sat on the mat, and it slept well.\n", "A second line of plain prose ends here.\n", "Rain fell on the old town all day.\n", "Nobody knew why the door was open.\n", "They went home before it was dark.\n", "The letter came late and said little.\n", "Snow is white, and so are the clouds.\n", "He read the book twice in a week.\n"]
JUNK = ["Buy### now$$$ cheap%%% pills&&& ###\n", "HOME!! ABOUT!! CONTACT!! LOGIN!! HELP\n", "a | b | c | d | e | f\n", "For For For For For For For For\n"]


def corpus():
    r = np.random.default_rng(5)
    texts, good = [], []
    for i in range(160):
        bad = i % 3 == 0
        texts.append("".join(JUNK[r.integers(4)] if bad and r.random() < 0.9 else p for p in r.permutation(PROSE)[: r.integers(3, 9)]))
        good.append(int(not bad))
    return texts, good


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(1)
    field = Field(r.normal(size=(2, len(NAMES))), r.normal(size=(2, 2)), r.normal(size=2))
    at = np.array([0, 3, 3, 4, 9, 10])
    x = r.random((10, len(NAMES)))
    got, score = viterbi(field, x, at), x @ field.emit.T
    for a, b in zip(at, at[1:], strict=False):
        if a < b:
            best = max(product((0, 1), repeat=b - a), key=lambda p, a=a: field.first[p[0]] + sum(score[a + i, v] for i, v in enumerate(p)) + sum(field.move[u, v] for u, v in zip(p, p[1:], strict=False)))
            assert tuple(got[a:b]) == best


def test_gradient_by_differences():
    r = np.random.default_rng(2)
    field = Field(r.normal(size=(2, len(NAMES))), r.normal(size=(2, 2)), r.normal(size=2))
    at, x, y = np.array([0, 3, 3, 7]), r.random((7, len(NAMES))), r.integers(0, 2, 7)
    value, g = gradient(field, x, at, y)
    for k, place in (("emit", (1, 3)), ("move", (0, 1)), ("first", (1,))):
        more = Field(field.emit.copy(), field.move.copy(), field.first.copy())
        getattr(more, k)[place] += 1e-6
        assert abs((gradient(more, x, at, y)[0] - value) / 1e-6 - getattr(g, k)[place]) < 1e-3


def test_features():
    x, chars, at = lines(pa.array(["AB cd\n\n Éé ##", None, "", "go go go\ngo go go.", " \n "]))
    assert at.tolist() == [0, 2, 2, 2, 4, 4] and chars.tolist() == [4, 5, 6, 7]  # É counts twice
    f = dict(zip(NAMES, x.T, strict=True))
    assert f["upper"][0] == 0.5 and f["symbols"][1] == 0.4 and f["repeats word"][2] == 1 and f["ends a sentence"].tolist() == [0, 0, 0, 1]
    assert lines(pa.array(["same line\nother\nsame line"]))[0][:, NAMES.index("line seen before")].tolist() == [0, 0, 1]


def test_held_out_documents(spark):
    texts, good = corpus()
    field = fit(texts[:100], good[:100])
    got = {r["doc_id"]: r for r in label_lines(docs(spark, texts[100:] + ["".join([*PROSE[:6], *JUNK[:3], *PROSE[6:]])]), field).collect()}
    assert np.mean([got[i]["keep"] == bool(g) for i, g in enumerate(good[100:])]) > 0.95
    assert got[60]["line_labels"] == "CCCCCCBBBCC" and got[60]["content_lines"] == 8


def test_hard_rows_and_training(spark):
    texts, good = corpus()
    d = docs(spark, HARD + [CLEAN], ids=[0, None, 2, 3, 3, 4, 5, 6, 7, 8, 9]).selectExpr("*", "1 keep", "2 n_lines")
    out = label_lines(d, fit(texts, good)).collect()
    assert len(out) == len(HARD) + 1
    for r in out:
        if r["doc_id"] in (0, None, 2):
            assert (r["n_lines"], r["content_share"], r["keep"], r["line_labels"]) == (0, 0.0, False, "")
    assert next(r for r in out if r["doc_id"] == 9)["keep"]
    assert label_lines(spark.createDataFrame([], DOCS), Field.zero()).collect() == []
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (0, 1, 0), (None, 1, 0), (9, None, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert training(d, labels, 10) == (["one two three four", "one two three four", "a"], [0, 0, 1])
    nothing = fit([], [])
    assert all(r["keep"] == (r["n_lines"] > 0) for r in label_lines(d, nothing).collect())


def test_blanks_at_the_end_of_a_line_change_nothing():
    at = NAMES.index("ends a sentence")
    for tail in ("", " ", "   ", " " * 50, "\t \r", " " * 5000):
        x, _, _ = lines(pa.array([f"It ends here.{tail}\nIt goes on,{tail}\nno more{tail}"]))
        assert x[:, at].tolist() == [1, 0, 0]
