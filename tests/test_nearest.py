"""The text most alike another, against its definition over all pairs."""

import random

import pytest

from tendermill.operators import nearest as module
from tendermill.operators.nearest import nearest

from .test_alike import names, plain_ratio


@pytest.mark.parametrize("floor", [0.3, 0.55, 1.0])
def test_nearest_equals_all_pairs(spark, monkeypatch, floor):
    """Several cells for each group, texts longer than a machine word, numbers that share one word, ties, null groups and blanks."""
    monkeypatch.setattr(module, "LEFT", 20)
    monkeypatch.setattr(module, "RIGHT", 15)
    draw = random.Random(3)
    numbered = lambda n: [f"supplier {draw.randint(0, 5000):09d}" for _ in range(n)]
    left = [(i % 3 if i % 17 else None, t) for i, t in enumerate(names(50, 1) + numbered(60))]
    right = [(i % 2 if i % 13 else None, 100 - i, t) for i, t in enumerate(names(40, 2) + numbered(40))]
    one, two = spark.createDataFrame(left, "u long, a string"), spark.createDataFrame(right, "u long, id long, b string")
    got = {(r["u"], r["a"]): (r["id"], round(r["x"], 9)) for r in nearest(one, two, "u", "a", "b", "id", floor, "x").collect()}
    for g, a in {(g, a) for g, a in left if g is not None}:
        found = [(-round(plain_ratio(a, b), 9), i) for h, i, b in right if h == g]
        score, i = min(found, default=(0.0, None))
        assert got.pop((g, a), None) == ((i, -score) if -score >= floor else None), (g, a)
    assert not got


def test_a_common_word_brings_no_pairs_together_as_rows(spark):
    """All texts share a word; what is shuffled are texts, and each is found once."""
    one = spark.range(3000).selectExpr("1 as u", "concat('supplier ', lpad(id * 7, 9, '0')) as a")
    two = spark.range(500).selectExpr("1 as u", "id", "concat('supplier ', lpad(id, 9, '0')) as b")
    rows = nearest(one, two, "u", "a", "b", "id", 0.55).collect()
    assert len(rows) == 3000
    assert {r["a"]: r["id"] for r in rows if r["relevancia"] == 1.0} == {f"supplier {i:09d}": i for i in range(0, 500, 7)}
