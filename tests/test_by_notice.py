"""Matching by notices: tenants and scores are lists, so nothing that is written or dealt out grows with items times tenants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tendermill import registry
from tendermill.operators import filters, matching, overlap
from tendermill.plans.views import VIEWS, Tables

SF = "/root/testdata/sf0.001"
MATCH = "usuario_id long, edital_id long"
TENANTS, NOTICES, ITEMS = 20, 40, 5


@pytest.fixture(scope="module")
def market(spark):
    """Every tenant asks for every item; the texts are few."""
    editais = spark.range(NOTICES).select("id", F.lit("papel").alias("objeto"))
    itens = spark.range(NOTICES * ITEMS).selectExpr("id div 5 as edital_id", "cast(id % 5 as int) as numero", "case when id % 11 = 0 then '' else concat('papel a', id % 7) end as descricao", "string(id % 4) as ncm", "cast(null as string) as catalogo_codigo")
    produtos = spark.range(TENANTS * 3).selectExpr("id", "id % 20 as usuario_id", "concat('papel a', id div 20) as descricao", "id % 13 <> 0 as ativo")
    scope = editais.select(F.col("id").alias("edital_id")).crossJoin(spark.range(TENANTS).select(F.col("id").alias("usuario_id"))).select("usuario_id", "edital_id")
    index = spark.range(TENANTS).selectExpr("id as usuario_id", "'ncm' as tipo", "'2' as codigo", "id as produto_id")
    old = spark.createDataFrame([(1, 1, "novo", False, False), (2, 0, "novo", False, False)], f"{MATCH}, status string, lido boolean, interessante boolean")
    excluded = spark.createDataFrame([(3, 0), (2, 0)], MATCH)
    # a product, none of these, a product that is gone, an item that is not there, a null number, and a pair out of scope
    confirmed = spark.createDataFrame([(1, 1, 1, 21), (1, 1, 2, None), (1, 1, 3, 999), (1, 1, 77, 21), (4, 2, None, 24), (3, 0, 1, 23)], f"{MATCH}, numero int, produto_id long")
    return editais, itens, produtos, scope, index, old, excluded, confirmed


def run(spark, market, scorer, full=True, **other):
    editais, itens, produtos, scope, index, old, excluded, confirmed = market
    mi = spark.createDataFrame([], f"{MATCH}, confirmado_manualmente boolean")
    return matching.full_matching(editais, itens, produtos, other.get("scope", scope), excluded, old, mi, other.get("confirmed", confirmed), scorer, index, full)


def by_rows(market, full, confirmed):
    """The same from a row for every item and tenant."""
    editais, itens, produtos, scope, index, old, excluded, _ = market
    asked = matching.incremental_scope(scope.join(excluded, ["usuario_id", "edital_id"], "left_anti"), old, full)
    best = matching.match_items(asked, matching.targets(editais, itens), matching.active_catalog(produtos), overlap.overlap_scorer, index)
    scores = best.select(*matching.ITEM_KEY, F.coalesce("score", F.lit(0.0)).alias("score"))
    return matching.rollup(matching.merge_confirmations(scores, confirmed.join(asked, ["usuario_id", "edital_id"], "left_semi"), produtos))


@pytest.mark.parametrize("full", [True, False])
@pytest.mark.parametrize("some", [True, False])
def test_lists_roll_up_as_rows_do(spark, market, full, some):
    confirmed = market[7] if some else market[7].limit(0)
    want = by_rows(market, full, confirmed)
    got, _, _ = run(spark, market, overlap.OverlapIndex(matching.active_catalog(market[2])), full, confirmed=confirmed)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert want.count() == TENANTS * NOTICES - (2 if full else 3)


def test_nothing_written_grows_with_items_times_tenants(spark, market, monkeypatch):
    counts = {}
    for module in (matching, overlap):
        keep = module.written
        monkeypatch.setattr(module, "written", lambda df, name, keep=keep: counts.setdefault(name, []).append((got := keep(df, name)).count()) or got)
    run(spark, market, overlap.OverlapIndex(matching.active_catalog(market[2])))[1].collect()
    assert max(n for c in counts.values() for n in c) < TENANTS * NOTICES * ITEMS / 4, counts


def test_pairs_that_few_tenants_ask_for(spark, market):
    """Each notice has a tenant of its own: texts are not asked for by all."""
    scope = spark.range(NOTICES).selectExpr("id % 20 as usuario_id", "id as edital_id")
    got, _, _ = run(spark, market, overlap.OverlapIndex(matching.active_catalog(market[2])), scope=scope)
    every, _, _ = run(spark, market, overlap.overlap_scorer)
    mine = every.join(scope, ["usuario_id", "edital_id"], "left_semi").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, mine.collect())) and got.count() == NOTICES


@pytest.mark.parametrize("most", [50, 0])
def test_scope_by_notice(spark, monkeypatch, most):
    monkeypatch.setattr(filters, "MAX_BROADCAST_BLOCKS", most)
    d = dt.date(2024, 1, 2)
    editais = spark.createDataFrame([(1, d), (2, None), (3, dt.date(2024, 1, 1)), (4, dt.date(2024, 1, 1)), (1, d)], "id long, data_encerramento date")
    users = spark.createDataFrame([(7,), (8,), (None,), (8,)], "id long")
    matches = spark.createDataFrame([(9, 1, "ganho"), (7, 3, "perdido"), (7, 2, "ganho"), (8, 4, "novo"), (8, 5, "ganho")], f"{MATCH}, status string")
    got = filters.scope_by_notice(editais, users, matches, d)
    pairs = [(u, r["edital_id"]) for r in got.collect() for u in r["usuarios"]]
    assert sorted(pairs) == sorted(tuple(r) for r in filters.matching_scope(editais, users, matches, d).collect())


def test_matches_need_no_pairs_of_items_and_tenants(spark):
    plan = registry.queries()["flt_02_by_flags"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Generate" not in plan


def test_matches_equal_their_definition(spark):
    """Scores that are null or under 0, notices of one tenant and of several."""
    rows = [(1, 1, 10, -0.5), (1, 2, 20, None), (2, 1, 10, -0.5), (2, 2, 11, -0.1), (3, 1, 10, None), (4, 1, 10, None), (4, 2, 13, 0.9), (4, 3, 23, 0.2), (5, 1, 15, 0.7), (None, 1, 15, 0.7)]
    itens = spark.createDataFrame(rows, "edital_id long, numero int, produto_ref long, score_ref double").withColumn("confirmado_ref", F.lit(False))
    itens.createOrReplaceTempView("defined_itens")
    spark.sql(VIEWS["item_scores"].replace("from itens", "from defined_itens").replace("join itens", "join defined_itens")).createOrReplaceTempView("defined_item_scores")
    want = spark.sql(VIEWS["matches"].replace("from item_scores", "from defined_item_scores"))
    got = Tables(spark, SF).matches_of(itens)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and want.count() == 7


@pytest.mark.parametrize("name", ["mat_16_full_matching"])
def test_items_lie_by_notice(spark, name):
    """What is asked of a notice's items finds them together: they are dealt out once, when they are numbered."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_excluded_pairs_are_found_once(spark, monkeypatch):
    """Batches of arrivals read what is excluded; none goes through all items for it."""
    from tendermill.plans import checks

    names, keep = [], checks.written
    monkeypatch.setattr(checks, "written", lambda df, name: names.append(name) or keep(df, name))
    assert registry.queries()["str_02_arrivals"](spark, SF).count() > 0
    assert names.count("excluded") == 1
