"""Texts most alike another: equal to all pairs, with few of them scored; checklists, codes and groups against plain definitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tendermill.functions.text import token_set_ratio
from tendermill.operators import search
from tendermill.operators.alike import AlikeTexts

PAIR = "usuario_id long, texto string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a, b):
    """The token-set similarity, by its definition."""
    s, t = set((a or "").split()), set((b or "").split())
    if not s or not t:
        return 0.0
    common, x, y = " ".join(sorted(s & t)), " ".join(sorted(s - t)), " ".join(sorted(t - s))
    if common and (not x or not y):
        return 1.0
    one, two = f"{common} {x}".strip(), f"{common} {y}".strip()
    alike = lambda p, q: 2 * lcs(p, q) / (len(p) + len(q))
    return max(alike(one, two), *([alike(common, one), alike(common, two)] if common else [0.0]))


def names(n, seed, letters="abcdeé 0"):
    draw = random.Random(seed)
    words = ["de", "certidao", "negativa", "municipal"] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(25)]
    return [" ".join(draw.choice(words) for _ in range(draw.randint(0, 6))) for _ in range(n)] + ["", None, " ", "de", "😀 de", "negativa " * 40, "abc" * 90]


@pytest.mark.parametrize(("k", "floor"), [(1, 0.55), (3, 0.5), (2, 0.9), (1, 1.0)])
def test_best_texts_equal_all_pairs(spark, k, floor):
    left = [(i % 3 if i % 17 else None, t) for i, t in enumerate(names(70, k))]
    right = [(i % 2 if i % 13 else None, t) for i, t in enumerate(names(60, k + 50))]
    got = {}
    for r in AlikeTexts(spark.createDataFrame(left, PAIR), spark.createDataFrame(right, "usuario_id long, nome string"), "usuario_id", "texto", "nome", floor, k).search().collect():
        got.setdefault((r["usuario_id"], r["texto"]), {})[r["nome"]] = round(r["relevancia"], 9)
    for g, a in {(g, a) for g, a in left if g is not None}:
        want = {b: round(plain_ratio(a, b), 9) for h, b in right if h == g}
        want = {b: v for b, v in want.items() if v >= floor}
        mine, reach = got.pop((g, a), {}), sorted(want.values(), reverse=True)[:k]
        assert all(want[b] == v for b, v in mine.items())
        assert {b for b, v in want.items() if not reach or v >= reach[-1]} <= set(mine), (g, a)
    assert not got


def test_few_pairs_get_an_edit_distance(spark):
    """Most texts are held under some other spelling; all pairs are never scored, though all have a word in common."""
    draw = random.Random(4)
    held = [f"certidao {''.join(draw.choice('abcdefghijklmnop') for _ in range(draw.randint(4, 30)))} {i}" for i in range(300)]
    asked = [t.replace("a", "o", 1) + "x" for t in held[:150]] + [t.split()[1] for t in held[150:250]] + ["qqqq wwww yyyy", "zz"]
    one = lambda texts, c: spark.createDataFrame([(1, t) for t in texts], f"usuario_id long, {c} string")
    index = AlikeTexts(one(asked, "texto"), one(held, "nome"), "usuario_id", "texto", "nome", 0.55)
    first = index.first()
    n = first.count() + index.second(index._scored(first)).count()
    assert 0 < n < 0.1 * len(asked) * len(held)


def test_nothing_to_compare(spark):
    none, some = spark.createDataFrame([], PAIR), spark.createDataFrame([(1, "a")], "usuario_id long, nome string")
    assert AlikeTexts(none, some, "usuario_id", "texto", "nome", 0.5).search().count() == 0
    with pytest.raises(ValueError, match="floor"):
        AlikeTexts(none, some, "usuario_id", "texto", "nome", 0.0)


def test_checklist_equals_a_plain_search(spark):
    """The best document of a requirement, the smallest id of equally good ones; lapsed, missing and inactive documents."""
    held = [(i, i % 2, n, i % 5 != 0, None if i % 3 == 0 else dt.date(2024, 1, 1 + i % 20)) for i, n in enumerate(names(60, 8) + ["certidao negativa", "Certidão  negativa"])]
    asked = names(20, 9) + ["certidao negativa municipal", "nada parecido"]
    docs = spark.createDataFrame(held, "id long, usuario_id long, nome string, ativo boolean, data_validade date")
    need = [(u, 7, {"tecnica": [a for a in asked if a is not None], "outra": ["x"]}) for u in (0, 1, 2)]
    required = spark.createDataFrame(need, "usuario_id long, edital_id long, exigencias map<string, array<string>>")
    rows = search.document_checklist(required, docs, dt.date(2024, 1, 10)).collect()
    assert len(rows) == 3 * sum(a is not None for a in asked)
    from tendermill.functions.text import expand_abbreviations

    every = list({*asked, *[h[2] for h in held]})
    plain = {r["t"]: r["e"] for r in spark.createDataFrame([(t,) for t in every], "t string").select("t", expand_abbreviations(F.col("t")).alias("e")).collect()}
    for r in rows:
        found = [(-plain_ratio(plain[r["exigido"]], plain[n]), i) for i, u, n, live, _ in held if live and u == r["usuario_id"]]
        score, doc = min(found, default=(0.0, None))
        want = (doc, round(-score, 2)) if -score >= 0.55 else (None, 0.0)
        assert (r["documento_id"], round(r["relevancia"], 2)) == (want[0], pytest.approx(want[1], abs=0.0101)), r
        assert (r["status"] == "nao_cadastrado") == (want[0] is None) and (r["status"] is None) == (want[0] is not None and r["data_validade"] is None)
        assert r["nome_cadastrado"] == (None if want[0] is None else held[want[0]][2])


def test_codes_equal_a_plain_search(spark):
    """Hits that contain all words stay at 0.9 or more, others from 0.5; a floor spares edit distances and changes no rank."""
    texts = [t or "" for t in names(80, 21)]
    hits = spark.createDataFrame([(q, i, f"c{i % 70}", t, "papel", i % 4 != 0) for q in (1, 2) for i, t in enumerate(texts)], "query_id long, ordem int, codigo string, descricao string, pdm string, ativo boolean")
    terms = {1: "certidao negativa", 2: "de papel"}
    got = {}
    for r in search.rank_codes(hits, spark.createDataFrame(list(terms.items()), "query_id long, termo string"), 12).orderBy("posicao").collect():
        got.setdefault(r["query_id"], []).append((r["codigo"], r["relevancia"]))
    from tendermill.functions.text import normalize

    plain = {r["t"]: r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", normalize(F.col("t")).alias("n")).distinct().collect()}
    for q, term in terms.items():
        seen, rows = set(), []
        for i, t in enumerate(texts):
            code = f"c{i % 70}"
            if code in seen:
                continue
            seen.add(code)
            inside = all(w in f"{plain[t]} papel" for w in term.split() if len(w) >= 2)
            score = max(plain_ratio(term, plain[t]), 0.9 if inside else 0.0)
            if inside or score >= 0.5:
                rows.append((i % 4 == 0, -round(score, 12), code))
        assert got.get(q, []) == [(c, pytest.approx(-s, abs=0.00051)) for _, s, c in sorted(rows)[:12]]


def test_a_floor_changes_nothing_above_it(spark):
    pairs = [(a, b) for a in names(25, 31) for b in names(25, 32)]
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = lambda floor: {(r["a"], r["b"]): r["ratio"] for r in token_set_ratio(frame, "a", "b", floor=floor).collect()}
    whole, cut = rows(None), rows(F.lit(0.6))
    assert all(round(v, 9) == round(plain_ratio(*k), 9) for k, v in whole.items())
    assert all(cut[k] == v if v >= 0.6 else cut[k] < 0.6 for k, v in whole.items())
