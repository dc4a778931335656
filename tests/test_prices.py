"""Medians of small and spread groups, and the items behind prices, without joining items with items."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tendermill import registry
from tendermill.functions import text
from tendermill.operators import business

SF = "/root/testdata/sf0.001"


def plan_of(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution()


@pytest.mark.parametrize("hot", [0, 3, 100, business.HOT_GROUP])
def test_medians_are_the_same_in_one_task_and_spread(spark, hot):
    """All groups spread, some, or none; a null group, nulls and equal values."""
    draw = random.Random(3)
    rows = [(draw.choice([1, 2, None]), float(draw.randint(0, 60))) for _ in range(400)] + [(4, None), (5, 2.5), (6, 1.0), (6, 4.0), (7, 3.0)] + [(7, 9.0)] * 2
    rows += [(9, draw.random()) for _ in range(301)]
    got = {r["produto_id"]: (r["m"], r["n"]) for r in business.group_median(spark.createDataFrame(rows, "produto_id long, valor double").repartition(3), ["produto_id"], hot=hot).collect()}
    want = {g: [v for k, v in rows if k == g and v is not None] for g in {k for k, _ in rows}}
    assert got == {g: (pytest.approx(statistics.median(v)), len(v)) for g, v in want.items() if v}


def test_small_groups_are_not_dealt_out_by_ranges(spark):
    frame = spark.createDataFrame([(1, 2.0), (1, 3.0)], "produto_id long, valor double")
    assert "ranges" not in " ".join(business.group_median(frame, ["produto_id"]).inputFiles())
    assert "ranges" in " ".join(business.group_median(frame, ["produto_id"], hot=1).inputFiles())


def test_the_count_of_a_package_is_looked_for_once(spark):
    """The pattern is tried once for a price, whatever branch holds it."""
    texts = ["Caixa com 12 unidades", "papel c/ 5 fls c/ 10 folhas", "luva (3 UND)", "kit 1", "cx 0", "pct 99999999999", "12x pacote", "cx 12x 3", None, "", "PEÇAS com 7 PEÇAS 8"]
    df = spark.createDataFrame([(t, 6.0) for t in texts] + [("cx 2", 0.0), ("cx 2", None)], "d string, p double")
    price = text.unit_price(F.col("d"), F.col("p"))
    groups = F.coalesce(*[F.nullif(F.regexp_extract("d", text.PACKAGE_PATTERN, g), F.lit("")) for g in (1, 2, 3)]).try_cast("int")
    want = F.when(F.col("p") > 0, F.when(F.coalesce(groups, F.lit(0)) > 1, F.col("p") / groups).otherwise(F.col("p")))
    assert df.filter(~price.eqNullSafe(want)).count() == 0 and df.filter(~text.package_count(F.col("d")).eqNullSafe(groups)).count() == 0
    assert df.select(price.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2


def test_bands_join_no_item_with_another(spark):
    """Matched items bring their own prices: the lines are read once."""
    given = []
    real = business.group_median

    def seen(values, *a, **k):
        given.append(values._jdf.queryExecution().optimizedPlan().toString())
        return real(values, *a, **k)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(business, "group_median", seen)
        plan_of(spark, "agg_04_outlier_band")
    assert given[0].count("l_partkey#") and given[0].count("Relation") == 2 and "Window" not in given[0]


def test_evidence_of_items_is_that_of_joined_tables(spark):
    draw = random.Random(8)
    drawn = lambda i: (draw.choice([None, *range(6)]) if i % 9 else None, i, draw.choice(["cx com 10 unidades", "papel", None]), draw.choice([None, 0.0, 1.0, 2.5, 900.0, 7.0]), draw.choice([None, None, 1, 2, 3]))
    itens = spark.createDataFrame([drawn(i) for i in range(200)], "edital_id long, numero int, descricao string, valor_unitario double, produto_id long")
    editais = spark.createDataFrame([(i, f"o{i}", "SP") for i in range(5)], "id long, orgao string, uf string")
    matched = itens.filter("produto_id is not null").select("edital_id", "numero", "produto_id", F.lit("alta").alias("confianca"), F.lit(False).alias("confirmado_manualmente"))
    want = business.price_evidence(matched, itens.drop("produto_id"), editais)
    got = business.evidence_of_items(itens, editais).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("motivo = 'fora_do_padrao'").count() > 0
