"""Cells of texts that share a token with few others: no such token parts the whole cell."""

import random
import time

import pytest

from tendermill import registry
from tendermill.operators import nearest as module

from .test_alike import plain_ratio


@pytest.mark.parametrize("few", [0, 7, 4096])
def test_a_cell_equals_all_pairs(monkeypatch, few):
    """Numbers that are on both sides, words of many texts, rests of up to 64 signs, longer texts, signs of every kind."""
    monkeypatch.setattr(module, "FEW", few)
    draw = random.Random(few)
    words = ["supplier", "a", "bb", "0\x00", "é😀", "x" * 20, "\ud800"]
    make = lambda n: sorted({draw.choice(words) for _ in range(draw.randint(0, 3))} | {f"{draw.randint(0, 60):0{draw.choice([2, 9, 40])}d}" for _ in range(draw.randint(1, n))})
    asked, held = [make(2) for _ in range(120)], [make(2) for _ in range(90)] + [["supplier"], ["a", "supplier"]]
    ratio, place = module._best(asked, held, 0.4)
    for tokens, r, at in zip(asked, ratio, place, strict=True):
        want = max((round(plain_ratio(" ".join(tokens), " ".join(h)), 9), -i) for i, h in enumerate(held))
        assert (round(r, 9), -at) == want if want[0] >= 0.4 else at == -1, tokens


def test_numbers_on_both_sides_cost_no_more():
    """Each number that both sides have was a pass over all texts of the cell."""
    asked = [[f"{i:09d}", "supplier"] for i in range(4000)]
    other, same = ([[f"{i + k:09d}", "supplier"] for i in range(400)] for k in (100_000, 0))
    took = []
    for held in (other, same):
        began = time.process_time()
        _, place = module._best(asked, held, 0.55)
        took.append(time.process_time() - began)
    assert place[:400].tolist() == list(range(400)) and took[1] < 0.2 + 5 * took[0]


def test_requirements_are_spelled_out_once(spark, monkeypatch):
    """What the best documents are joined to is read, not spelled out again."""
    plan = registry.queries()["mat_20_checklist"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("certidao negativa de debitos trabalhistas") <= 2
