"""Queries and operators do the whole job: nothing is cut, and no group grows with a table."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tendermill import registry
from tendermill.functions import text
from tendermill.operators import search
from tendermill.plans import checks
from tendermill.plans import functions as plans

ORDERS, PARTS = 30_000, 12_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Orders and parts of more rows than the smallest tables have."""
    d = tmp_path_factory.mktemp("wide")
    o = spark.range(ORDERS).select(F.col("id").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit(1.0).alias("o_totalprice"), F.lit(dt.datetime(1996, 1, 1)).alias("o_orderdate"), F.lit("5-LOW").alias("o_orderpriority"))
    o.write.parquet(f"{d}/orders.parquet")
    spark.sql("select 1L as c_custkey, 'c' as c_name, 'BUILDING' as c_mktsegment, 1L as c_nationkey").write.parquet(f"{d}/customer.parquet")
    spark.sql("select 1L as n_nationkey, 'n' as n_name").write.parquet(f"{d}/nation.parquet")
    spark.range(PARTS).selectExpr("id as p_partkey", "'x' as p_name", "'b' as p_brand", "'t' as p_type", "1.0D as p_retailprice", "1 as p_size").write.parquet(f"{d}/part.parquet")
    return str(d)


def test_pages_of_notices_keep_their_size(spark, wide):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.glob("pages-*"))
    got = registry.queries()["src_01_read_pages"](spark, wide)
    assert got.count() == sum(k % 19 != 0 for k in range(ORDERS))
    (path,) = set(root.glob("pages-*")) - before
    sizes = [r["n"] for r in spark.read.text(str(path)).select(F.regexp_count("value", F.lit("objetoCompra")).alias("n")).collect()]
    assert sum(sizes) == ORDERS and max(sizes) <= 500


def test_pages_of_hits_keep_their_size(spark, wide, monkeypatch):
    seen, whole = [], plans.notices.map_catalog_hits
    monkeypatch.setattr(plans.notices, "map_catalog_hits", lambda raw, *a: seen.append(raw) or whole(raw, *a))
    assert registry.queries()["src_11_catalog_hits"](spark, wide).count() == PARTS
    sizes = [r["n"] for r in seen[0].select(F.regexp_count("p", F.lit("nomePdm")).alias("n")).collect()]
    assert sum(sizes) == PARTS and max(sizes) <= 500


GROUPS = [(1, "Papelaria geral", True), (2, "Canetas", True), (3, "Parafuso sextavado", True), (4, "Papel A4", True), (5, "Grampos", False), (6, "", True), (7, "canetas", None), (8, "papel", False), (9, "Clipe", True)]
TERMS = [(1, "papel"), (2, "caneta"), (3, "Grampo"), (4, "xyz"), (5, "papel")]


@pytest.mark.parametrize(("groups", "top", "block"), [(GROUPS, 6, []), (GROUPS, 2, [2]), ([(k, n, False) for k, n, _ in GROUPS], 3, [1])])
def test_groups_are_ranked_over_all_names(spark, groups, top, block):
    alive = [g for g in groups if g[2] is not False] or groups
    pairs = [(q, t.lower(), k, n.lower()) for q, t in TERMS for k, n, _ in alive]
    scored = text.token_set_ratio(spark.createDataFrame(pairs, "q long, a string, k long, b string"), "a", "b", "s").collect()
    want = []
    for q, _ in TERMS:
        mine = [(max(r["s"], 0.9) if r["b"] and (r["a"] in r["b"] or r["b"] in r["a"]) else r["s"], r["k"]) for r in scored if r["q"] == q]
        want += [(q, k, round(s, 9), i) for i, (s, k) in enumerate(sorted(mine, key=lambda m: (-m[0], m[1]))[:top], 1)]
    got = search.rank_groups(spark.createDataFrame(groups, "grupo long, nome string, ativo boolean"), spark.createDataFrame(TERMS, "query_id long, termo string"), top, *block)
    assert sorted(((r["query_id"], r["grupo"], round(r["relevancia"], 9), r["posicao"]) for r in got.collect()), key=lambda r: (r[0], r[3])) == want


def test_exclusions_follow_the_rules_of_all_customers(spark):
    sf = "/root/testdata/sf0.001"
    keys = [r["k"] for r in spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k")).collect()]
    got = {r["usuario_id"] for r in registry.queries()["flt_10_exclude_all"](spark, sf).select("usuario_id").distinct().collect()}
    assert got == {k % 10 for k in keys}


def test_all_parts_are_checked(spark, wide, monkeypatch):
    seen, whole = [], checks.validation.check_categorical
    monkeypatch.setattr(checks.validation, "check_categorical", lambda p: seen.append(p) or whole(p))
    assert registry.queries()["val_06_categorical"](spark, wide).count() == sum(k % 8 == 0 or k % 12 == 0 for k in range(PARTS))
    assert seen[0].count() == PARTS
