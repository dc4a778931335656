"""Choices from lists, against those from rows; the notice's items are dealt out once."""

import random

import pytest
from pyspark.sql import functions as F

from tendermill import registry
from tendermill.operators import business, matching


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(5)
    made = [(u, e, n, draw.randint(1, 6), draw.choice([0.0, -0.5, 0.2, 0.3, 0.4, 0.9, 0.9, 1.0, None])) for u in (1, 2) for e in range(8) for n in (1, 2) for _ in range(draw.randint(1, 7))]
    return spark.createDataFrame(made, "usuario_id long, edital_id long, numero int, produto_id long, score double")


def lists_of(rows):
    return rows.groupBy(*matching.ITEM_KEY).agg(F.collect_list(F.struct("produto_id", "score")).alias("p"))


def test_lists_give_what_rows_give(rows):
    """Repeated products count by their best score; ties, nulls and scores that are not positive."""
    want = matching.chosen(rows.groupBy(*matching.ITEM_KEY, "produto_id").agg(F.max("score").alias("score")))
    got = matching.chosen_of_lists(lists_of(rows), F.col("p")).drop("p").select(*want.columns)
    assert want.count() > 20
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_live_products_of_lists(spark, rows):
    produtos = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0), (2, 1, "c", None), (2, 4, None, 3.0), (1, 5, "d", 4.0)], "usuario_id long, id long, descricao string, preco_custo double")
    items = matching.chosen_of_lists(lists_of(rows), F.col("p"))
    alive = business.with_live_products(spark.range(8).select(F.col("id").alias("ref")), produtos, "ref").agg(F.flatten(F.collect_list("vivos")).alias("vivos"))
    got = business.live_of_lists(items.crossJoin(alive)).collect()
    assert sorted(map(str, got)) == sorted(map(str, business.live_candidates(items, produtos).collect())) and got


def test_places_in_a_list_are_those_of_rows(spark, rows):
    """Ties by number, scores under the floor, null scores and texts; nothing is placed by a window."""
    items = lists_of(rows).withColumn("descricao", F.when(F.col("numero") == 1, F.repeat(F.lit("ab"), 90)))
    want = matching.placed_rows(matching.confidence(matching.chosen_of_lists(items, F.col("p")).drop("p"))).drop("motivo", "confianca", "confirmado_manualmente")
    notices = items.groupBy(*matching.MATCH_KEY).agg(F.collect_list(F.struct("numero", "descricao", "p")).alias("todos"))
    got = matching.placed_of_lists(notices, lambda x: x["p"])
    assert want.count() > 10
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    plan = registry.queries()["mat_10_detail"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "l_linenumber" in next(line for line in plan.splitlines() if "Window [" in line)


@pytest.mark.parametrize("name", ["mat_06_best", "mat_08_confidence", "mat_10_detail", "mat_11_rollup", "mat_12_level", "mrg_02_live_candidates", "snk_09_purge_weak"])
def test_items_are_read_once(spark, name):
    """No item is joined with another: the lines are read once, and dealt out by product and by notice."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_equal_catalog_texts_are_paired_once(spark):
    """Both sides of the pairs are made distinct before they are joined."""
    plan = registry.queries()["mat_03_text_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Join Inner")
    below = plan[at:].splitlines()
    depth = len(below[1]) - len(below[1].lstrip(" :|+-"))
    assert sum("Aggregate [" in line and len(line) - len(line.lstrip(" :|+-")) == depth for line in below[1:]) == 2
