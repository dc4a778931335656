"""What made queries dear on larger tables: values taken again and again, rows that can't count, and tables joined with themselves."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tendermill import registry
from tendermill.functions import shapes
from tendermill.functions.numbers import cosine, rounded, rounded_column
from tendermill.operators import matching

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("schema", ["string", "boolean"])
def test_the_kind_of_a_value_is_taken_once(spark, schema):
    rows = spark.sql("""select parse_json(x) as v from values ('1'), ('2.50'), ('"a"'), ('null'), ('[1]'), ('{}'), ('false'), (null) t(x)""")
    got = rows.select(shapes.shaped(F.col("v"), T.StringType() if schema == "string" else T.BooleanType()).alias("s"))
    assert got._jdf.queryExecution().analyzed().toString().lower().count("schema_of_variant(") == 1
    want = ["1", "2.5", "a", "", "[1]", "", "", ""] if schema == "string" else [True, True, True, False, True, False, False, False]
    assert [r["s"] for r in got.collect()] == want


def test_codes_are_looked_up_for_own_products_alone(spark):
    """Rows that are under the floor leave before any code is looked up, and no item is dealt out by its notice's tenants."""
    plan = plan_of(registry.queries()["mat_05_code_winners"](spark, SF))
    assert plan.count("lineitem.parquet") == 1 and "collect_set" not in plan


def test_matched_items_are_read_from_the_lines_once(spark):
    plan = plan_of(registry.queries()["flt_13_trusted"](spark, SF))
    assert "collect_set" not in plan


def test_all_pairs_are_scored_where_they_meet(spark):
    """The scores are those of the scorer by text, for vectors of all shapes, and no pair is shuffled."""
    vectors = [("a", [1.0, 2.0, 3.0]), ("b", [0.0, 0.0, 0.0]), ("c", [1.0]), ("d", []), ("e", None), ("f", [-1.0, 0.5, 2.0]), ("g", [1.0, None, 2.0])]
    items = spark.createDataFrame(vectors, "texto_item string, vetor array<double>")
    products = items.withColumnRenamed("texto_item", "texto_produto")
    pairs = items.select("texto_item").crossJoin(products.select("texto_produto"))
    want = matching.vector_scorer(items, products)(pairs).select("texto_item", "texto_produto", "score").collect()
    got = matching.score_all(items, products)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 49
    plan = plan_of(registry.queries()["mat_03_score_pairs"](spark, SF))
    assert plan.count("embeddings.parquet") == 2


@pytest.mark.parametrize("name", ["mat_14_lifecycle", "mat_16_run_matching"])
def test_confirmations_are_dealt_out_once(spark, name):
    """Confirmations meet scores without a join of all items."""
    plan = plan_of(registry.queries()[name](spark, SF))
    assert "REPARTITION_BY_NUM" in plan


def test_confirmations_meet_items_by_whole_keys(spark):
    scores = spark.createDataFrame([(1, 1, 1, 0.4), (1, 1, None, 0.2), (1, 1, 2, None), (1, 2, 1, 0.6)], "usuario_id long, edital_id long, numero int, score double")
    confirmed = spark.createDataFrame([(1, 1, 1, 9), (1, 1, 2, None), (1, 3, 1, 9), (1, 2, 1, 8)], "usuario_id long, edital_id long, numero int, produto_id long")
    got = matching.merge_confirmations(scores, confirmed, spark.createDataFrame([(9, 1)], "id long, usuario_id long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, 1, 1.0), (1, 1, None, 0.2), (1, 1, 2, 0.0), (1, 2, 1, 0.6), (1, 3, 1, 1.0)], key=str)


def test_items_without_a_product_are_not_dealt_out_by_product(spark):
    """The last join is by item: a product's facts are known before."""
    plan = registry.queries()["mrg_02_notice_detail"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "numero" in next(line for line in plan.splitlines() if "Join LeftOuter" in line)


@pytest.mark.parametrize(("items", "products", "rows"), [(3, 2, 1), (2048, 1024, 4)])
def test_cells_score_as_columns_do(spark, monkeypatch, items, products, rows):
    """Vectors of all shapes over many cells, to the last bit; nulls, zeros, numbers that are none, repeated texts."""
    draw = random.Random(items)
    shape = lambda i: [[draw.gauss(0, 1) for _ in range(6)], [draw.gauss(0, 1) for _ in range(3)], [0.0] * 6, [1.0, None, 2.0], [], None, [float("nan"), 1.0, 2.0], [1e200] * 6][i % 8]
    one, two = ([(f"{s}{i}" if i else None, shape(i)) for i in range(n)] + [(f"{s}1", shape(8))] for s, n in (("a", 25), ("b", 40)))
    for name, value in (("CELL_ITEMS", items), ("CELL_PRODUCTS", products), ("CELL_ROWS", rows)):
        monkeypatch.setattr(matching, name, value)
    left, right = spark.createDataFrame(one, "texto_item string, vetor array<double>"), spark.createDataFrame(two, "texto_produto string, vetor array<double>")
    pairs = left.withColumnRenamed("vetor", "__i").crossJoin(right.withColumnRenamed("vetor", "__p"))
    want = pairs.select("texto_item", "texto_produto", cosine(F.col("__i"), F.col("__p")).alias("score")).collect()
    got = matching.score_all(left, right)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 26 * 41


def test_pairs_are_scored_as_columns_of_numbers(spark):
    """No plan node takes one sum for each pair."""
    plan = plan_of(registry.queries()["mat_03_score_pairs"](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n", [0, 2, 5, 7])
def test_quick_rounding_is_rounding(spark, n):
    draw = random.Random(n)
    some = [draw.uniform(-2, 2) for _ in range(3000)] + [round(draw.randint(-(10**6), 10**6) * 10.0**-n + 5 * 10.0 ** (-n - 1), 10) for _ in range(2000)]
    some += [0.0, -0.0, 1e-9, -1e-9, 0.125, -0.125, 2.5, -2.5, 999.999999, 1000.0, 123456.7890125, float("nan"), float("inf"), None, 0.000005, 0.0000049999, 0.00000499999999, -0.00000499999999]
    rows = spark.createDataFrame([(x,) for x in some], "x double").select("x", rounded("x", n).alias("a"), rounded_column("x", n).alias("b")).collect()
    assert [r for r in rows if str(r["a"]) != str(r["b"])] == []
