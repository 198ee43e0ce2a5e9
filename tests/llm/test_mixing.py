from collections import Counter

import pytest

from quirework.llm.mixing import mix, rates
from tests.llm.helpers import DOCS, HARD, docs


def test_rates_and_copies(spark):
    d = docs(spark, ["a b c d"] * 30 + ["a b"] * 10, ["x"] * 30 + ["y"] * 10)
    r = {x["source"]: x["rate"] for x in rates(d, {"x": 1.0, "y": 3.0}).collect()}
    assert r == {"x": 1 * 140 / (4 * 120), "y": 3 * 140 / (4 * 20)}
    n = Counter(x["doc_id"] for x in mix(d, {"x": 1.0, "y": 3.0}).collect())
    assert all(n[i] in (0, 1) for i in range(30)) and all(n[i] in (5, 6) for i in range(30, 40))
    assert 2 <= sum(n[i] for i in range(30)) <= 17


def test_shares_reach_the_weights(spark):
    d = docs(spark, ["a b c d"] * 4000, ["x"] * 3000 + ["y"] * 1000)
    n = Counter(x["source"] for x in mix(d, {"x": 1.0, "y": 1.0}).collect())
    assert abs(n["x"] - 2000) < 120 and n["y"] == 2000


def test_large_table_of_rates_gives_the_same(spark):
    d = docs(spark, [f"w{i} " * (i % 7) for i in range(60)], [f"s{i % 5}" if i % 9 else None for i in range(60)])
    a, b = (sorted(map(tuple, mix(d, {"s1": 4.0, None: 2.0}, broadcast_sources=m).collect()), key=repr) for m in (100, 0))
    assert a == b and a


def test_hard_rows(spark):
    d = docs(spark, HARD, [None, "a", "a", "a", "a", None, "b", "b", "c", "c"], [0, None, 1, 2, 2, 3, 4, 5, None, 6])
    out = mix(d, {}, budget=10).collect()
    assert {x["doc_id"] for x in out} <= {0, None, 1, 2, 3, 4, 5, 6}
    empty = docs(spark, ["", None, " "], ["z"] * 3)
    assert mix(empty, {}).count() == 3
    assert mix(spark.createDataFrame([], DOCS), {}).collect() == []
    with pytest.raises(ValueError):
        mix(d, {"a": -1.0})


def test_extra_columns(spark):
    d = docs(spark, ["a b"] * 4).selectExpr("*", "1 mix_rate", "2 mix_source", "'z' tokens", "7 Copy_No", "3 rate", "4 weight")
    out = mix(d, {"s0": 1.0})
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_rate", "mix_source", "tokens", "rate", "weight", "copy_no"]
    assert out.count() == 4
