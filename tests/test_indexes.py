"""Searches that never make all pairs, and medians of hot groups, against plain definitions."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tendermill.operators import business, matching, overlap, search, terms

MATCH = "usuario_id long, edital_id long"


def word_rows(n, seed, vocabulary=60, most=9):
    """Texts of words of very different frequency, some of them blank, equal or very long."""
    draw = random.Random(seed)
    some = [f"w{int(vocabulary * draw.random() ** 3)}" for _ in range(4000)]
    out = [" ".join(draw.choice(some) for _ in range(draw.randint(0, most))) for _ in range(n)]
    return out + ["", "  ", "só", " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(0, 60, 2))]


def plain_scores(texts, products):
    """``tenant, text: [(product, score)]`` of all pairs, the best first."""
    out = {}
    for tenant, text in texts:
        a = set(text.replace("ó", "o").split())
        found = [(len(a & set(t.split())) / len(a | set(t.split())), -k) for k, own, t in products if own == tenant and a and t.split() and a & set(t.split())]
        out[tenant, text] = [(-k, s) for s, k in sorted(found, reverse=True)]
    return out


@pytest.mark.parametrize(("seed", "vocabulary", "most"), [(1, 60, 9), (2, 400, 6), (3, 8, 5), (4, 200, 40)])
def test_best_products_equal_all_pairs(spark, seed, vocabulary, most):
    products = [(i, i % 2, t) for i, t in enumerate(word_rows(400, seed, vocabulary, most))]
    texts = [(i % 3, t) for i, t in enumerate(word_rows(250, seed + 10, vocabulary, most))]
    live = spark.createDataFrame(products, "id long, usuario_id long, descricao string")
    names = sorted({t for _, t in texts})
    numbered = spark.createDataFrame(list(enumerate(names)), "texto_id long, texto string")
    asked = spark.createDataFrame([(u, names.index(t)) for u, t in texts], "usuario_id long, texto_id long")
    also = spark.createDataFrame([(0, names.index(texts[0][1]), 0), (0, names.index(texts[3][1]), 2), (0, names.index(texts[3][1]), 99_999)], "usuario_id long, texto_id long, produto_id long")
    got = {}
    for r in overlap.OverlapIndex(live).search(asked, numbered, also=also).collect():
        got.setdefault((r["usuario_id"], names[r["texto_id"]]), set()).add((r["produto_id"], round(r["score"], 12)))
    clean = [(k, u, t.replace("ó", "o").strip()) for k, u, t in products]
    want = plain_scores({(u, t) for u, t in texts}, clean)
    for key, best in want.items():
        top = {(k, round(s, 12)) for k, s in best[:3]}
        extra = got.get(key, set()) - top
        assert top <= got.get(key, set()) and all(k in (0, 2) for k, _ in extra), key
        for k, s in extra:
            assert s == round(dict(best).get(k, 0.0), 12)


def test_few_pairs_are_scored(spark):
    """Of texts times products less than a tenth is scored, though every text has a word that most products have."""
    draw = random.Random(7)
    make = lambda: "de para " + " ".join(f"c{draw.randrange(90)}" for _ in range(5))
    products = spark.createDataFrame([(i, 1, make()) for i in range(1500)], "id long, usuario_id long, descricao string")
    texts = spark.createDataFrame([(i, make() + " caixa com 12") for i in range(300)], "texto_id long, texto string")
    index = overlap.OverlapIndex(products)
    asked = texts.select(F.lit(1).cast("long").alias("usuario_id"), "texto_id")
    _, sets = index.sets(asked, texts)
    first = index.first_round(sets)
    best = index._best(first, sets, 3)
    scored = first.count() + index.second_round(sets, best, 3).count()
    assert 0 < scored < 0.1 * 300 * 1500


def test_long_texts_and_catalogs_without_words(spark):
    products = spark.createDataFrame([(1, 1, " ".join(f"a{i}" for i in range(200))), (2, 1, None), (3, 1, "--"), (4, 2, "a1")], "id long, usuario_id long, descricao string")
    texts = spark.createDataFrame([(1, "a1 b"), (2, " ".join(f"a{i}" for i in range(100))), (3, "")], "texto_id long, texto string")
    asked = spark.createDataFrame([(u, t) for u in (1, 2, 3) for t in (1, 2, 3)], "usuario_id long, texto_id long")
    got = {tuple(r) for r in overlap.OverlapIndex(products).search(asked, texts).collect()}
    assert got == {(1, 1, 1, 1 / 201), (1, 2, 1, 0.5), (2, 1, 4, 0.5), (2, 2, 4, 0.01)}
    with pytest.raises(ValueError, match="fewer"):
        overlap.OverlapIndex(products).search(asked, texts, 9)


def test_index_and_all_pairs_choose_alike(spark):
    products = [(i, i % 2, True, t) for i, t in enumerate(word_rows(120, 5, 30))]
    live = spark.createDataFrame(products, "id long, usuario_id long, ativo boolean, descricao string")
    items = spark.createDataFrame([(i % 9, i, t, str(i % 7), str(i % 5)) for i, t in enumerate(word_rows(90, 6, 30))], "edital_id long, numero int, texto string, ncm string, catalogo_codigo string")
    scope = spark.createDataFrame([(u, e) for u in (0, 1) for e in range(9)], MATCH)
    index = spark.createDataFrame([(u, "ncm", str(c), 10 * c + u) for u in (0, 1) for c in range(1, 7)], "usuario_id long, tipo string, codigo string, produto_id long")
    for codes in (None, index):
        show = lambda df: sorted(str(tuple(r)) for r in df.select("usuario_id", "edital_id", "numero", "texto", "produto_id", "score", "motivo", "segundo", "candidatos").collect())
        assert show(matching.match_items(scope, items, live, overlap.OverlapIndex(live), codes)) == show(matching.match_items(scope, items, live, overlap.overlap_scorer, codes))


def test_confirmed_items_stay_in_the_detail(spark):
    """A confirmed product and a "none of these" outlive a full run; one whose product is gone does not; one without a fresh row comes last."""
    editais = spark.createDataFrame([(1, "x")], "id long, objeto string")
    itens = spark.createDataFrame([(1, n, d) for n, d in [(1, "papel a4"), (2, "caneta azul"), (3, "grampo"), (4, "zzz")]], "edital_id long, numero int, descricao string")
    produtos = spark.createDataFrame([(5, 1, "papel a4", True), (6, 1, "caneta azul", True), (7, 1, "grampo", True), (8, 1, "outro", True)], "id long, usuario_id long, descricao string, ativo boolean")
    old = spark.createDataFrame([(1, 1, "novo", False, False)], f"{MATCH}, status string, lido boolean, interessante boolean")
    mi = spark.createDataFrame([(1, 1, True)], f"{MATCH}, confirmado_manualmente boolean")
    confirmed = spark.createDataFrame([(1, 1, 1, 8), (1, 1, 2, None), (1, 1, 3, 99), (1, 1, 4, 8)], f"{MATCH}, numero int, produto_id long")
    scope, none = old.select("usuario_id", "edital_id"), spark.createDataFrame([], MATCH)
    rolled, actions, detail = matching.full_matching(editais, itens, produtos, scope, none, old, mi, confirmed, overlap.OverlapIndex(produtos))
    rows = [(r["numero"], r["produto_id"], r["score_item"], r["confirmado_manualmente"], r["posicao"]) for r in detail.orderBy("posicao").collect()]
    assert rows == [(1, 8, 1.0, True, 1), (2, None, 0.0, True, 2), (3, 7, 1.0, False, 3), (4, 8, 1.0, True, 4)]
    assert rolled.first()["melhor"] == 1.0 and actions.first()["acao"] == "atualizar"


# ---------------------------------------------------------------- terms and phrases


@pytest.mark.parametrize(("n_terms", "shard_terms"), [(100_000, 200_000), (3_000, 700)])
def test_many_terms_in_one_walk(spark, n_terms, shard_terms):
    draw = random.Random(n_terms)
    letters = "abcdef"
    own = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(n_terms)} | {"", "papel a4", "é"}
    texts = [(i, "".join(draw.choice(letters + " ") for _ in range(draw.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "so papel a4 é"), (901, "so papel a4 é")]
    frame = spark.createDataFrame([(t,) for t in own] + [(None,), ("papel a4",)], "termo string")
    hits = terms.term_hits(spark.createDataFrame(texts, "k long, t string").repartition(3), frame, "k", "t", shard_terms=shard_terms)
    assert hits.columns == ["k", "termo"]
    want = {(k, t[i:j]) for k, t in texts if t for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in own}
    got = [tuple(r) for r in hits.collect()]
    assert set(got) == want and got.count((901, "papel a4")) == 2


def test_no_terms_no_hits(spark):
    frame = spark.createDataFrame([(None,), ("",)], "termo string")
    assert terms.term_hits(spark.createDataFrame([(1, "a")], "k long, t string"), frame, "k", "t").count() == 0


def test_phrases_equal_contains(spark):
    draw = random.Random(3)
    make = lambda n: "".join(draw.choice("ABC é😀") for _ in range(n))
    corpus = [(i, make(draw.randint(0, 25))) for i in range(300)] + [(500, None), (501, "AB"), (501, "AB"), (502, "ABCABC")]
    asked = [make(draw.randint(1, 7)) for _ in range(150)] + ["", None, "ABCABC", "ZZZ", "A"]
    frame = spark.createDataFrame(corpus, "codigo long, texto string")
    got = {tuple(r) for r in terms.PhraseIndex(frame, "texto", "codigo").search(spark.createDataFrame([(a,) for a in asked], "q string"), "q").collect()}
    assert got == {(q, k) for q in asked if q for k, t in corpus if t and q in t}


def test_phrase_or_words_has_no_nested_loop(spark):
    corpus = spark.createDataFrame([(1, "papel sulfite a4"), (2, "papel"), (3, "caneta azul"), (4, None)], "codigo long, texto string")
    asked = spark.createDataFrame([(1, " Papel "), (2, "caneta verde"), (3, "xyz"), (4, ""), (5, None)], "query_id long, termo string")
    got = search.phrase_or_words(corpus, asked, "texto", "codigo")
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} == {(1, 1), (1, 2), (2, 3)}


# ---------------------------------------------------------------- medians


def test_medians_of_a_hot_group(spark):
    """One product has a third of all rows, another one value only; nulls don't count, a null group is a group."""
    draw = random.Random(11)
    rows = [(draw.choice([1, 2, 3, None]), round(draw.expovariate(1), 2)) for _ in range(600)] + [(9, round(draw.expovariate(1), 3)) for _ in range(300)]
    rows += [(8, 2.5)] * 40 + [(7, None)] * 3 + [(6, 1.0), (6, 4.0), (6, None)] + [(5, -1.0)]
    frame = spark.createDataFrame(rows, "produto_id long, valor double").repartition(4)
    got = {r["produto_id"]: (r["m"], r["n"]) for r in business.group_median(frame, ["produto_id"]).collect()}
    want = {k: [v for g, v in rows if g == k and v is not None] for k in {k for k, _ in rows}}
    assert got == {k: (pytest.approx(statistics.median(v)), len(v)) for k, v in want.items() if v}
    assert "percentile" not in business.outlier_band(frame, ["produto_id"])._jdf.queryExecution().toString()


def test_median_of_nothing(spark):
    assert business.group_median(spark.createDataFrame([], "produto_id long, valor double"), ["produto_id"]).count() == 0


# ---------------------------------------------------------------- states that count as followed


def test_followed_states(spark):
    import datetime as dt

    from tendermill.operators import filters, tables

    states = ["novo", "vou_participar", "proposta_enviada", "ganho", "perdido", "descartado"]
    as_of = dt.date(2024, 1, 2)
    matches = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], f"{MATCH}, status string")
    editais = spark.createDataFrame([(i, dt.date(2024, 1, 1), dt.date(2024, 1, 1)) for i in range(6)], "id long, data_abertura date, data_encerramento date")
    itens = spark.createDataFrame([(i, None) for i in range(6)], "edital_id long, unidade_medida string")
    users = spark.createDataFrame([(1,)], "id long")
    want = {i for i, s in enumerate(states) if s in ("proposta_enviada", "ganho", "perdido")}
    closed = filters.view_closed(matches.join(editais.withColumnRenamed("id", "edital_id"), "edital_id"), as_of)
    assert {r["edital_id"] for r in closed.collect()} == want
    assert {r["edital_id"] for r in filters.matching_scope(editais, users, matches, as_of).collect()} == want
    assert {r["id"] for r in tables.backfill_scope(editais, itens, matches, as_of, filters.TRACKED).collect()} == want
