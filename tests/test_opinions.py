"""Second opinions from answers of every wrong shape, against a reading part by part; items are numbered once."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tendermill import registry
from tendermill.operators import search
from tendermill.sources.notices import get, parse_response

KEY = ["usuario_id", "edital_id", "numero"]


def part_by_part(responses, itens, produtos, k):
    rows = responses.select("usuario_id", "edital_id", F.explode(F.try_variant_get(parse_response(F.col("resposta")), "$.itens", "array<variant>")).alias("i"))
    cand = rows.select("usuario_id", "edital_id", get(F.col("i"), "item", "int").alias("numero"), F.posexplode(F.try_variant_get("i", "$.candidatos", "array<variant>")).alias("ordem", "c"))
    cand = cand.select(*KEY, "ordem", get(F.col("c"), "produto_id", "bigint").alias("produto_id"), get(F.col("c"), "motivo").alias("motivo"))
    known = cand.join(itens.select("edital_id", "numero"), ["edital_id", "numero"], "left_semi").join(produtos.select("usuario_id", F.col("id").alias("produto_id")), ["usuario_id", "produto_id"], "left_semi")
    first = known.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY, "produto_id").orderBy("ordem"))).filter("__n = 1")
    return first.withColumn("posicao", F.row_number().over(Window.partitionBy(*KEY).orderBy("ordem"))).filter(F.col("posicao") <= k).select(*KEY, "posicao", "produto_id", "motivo")


def test_answers_of_every_shape(spark):
    c = lambda p, m="x": {"produto_id": p, "motivo": m}
    candidates = [
        [c(1), c(1), c(2), c(3)], [c("2"), c(3)], [c(2.0), c(1.5), c(3.7)], [c("a"), c(1)], [c(True), c(2)], [c(None), c(3)], [c([1]), c({"a": 1}), c(2)], [5, "x", None, [], c(1)],
        {"produto_id": 1}, "2", None, [], [c(99), c(1, None)], [c(2, 7), c(3, ["m"]), c(1, {"m": 1})], [{"produto_id": 2}, {"motivo": "y"}, {"Produto_id": 1}], [c(2**70), c(1, True)], [c(1e30), c(2, 1.5)],
    ]
    items = [1, "2", 3.0, 2.5, None, "x", [1], True, 2**40, 9, {"a": 1}]
    answers = [json.dumps({"itens": [{"item": i, "candidatos": x}]}) for x in candidates for i in (1, "2")] + [json.dumps({"itens": [{"item": i, "candidatos": candidates[0]}]}) for i in items]
    answers += [json.dumps({"itens": x}) for x in (None, 1, "a", {}, [], [1, None, "a", [2], {"item": 3, "candidatos": candidates[1]}], {"item": 1, "candidatos": candidates[0]})]
    whole = json.dumps({"itens": [{"item": 1, "candidatos": candidates[0]}, {"item": 2}, {"candidatos": candidates[0]}]})
    answers += [f"```json\n{whole}```", whole[:30], "", None, "[]", "null", whole + whole]
    responses = spark.createDataFrame([(1, e, a) for e, a in enumerate(answers)], "usuario_id long, edital_id long, resposta string")
    itens = spark.range(len(answers)).select(F.col("id").alias("edital_id"), F.explode(F.array(*[F.lit(n) for n in (0, 1, 2, 3)])).alias("numero"))
    produtos = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 99)], "usuario_id long, id long")
    for k in (1, 2):
        want = part_by_part(responses, itens, produtos, k).collect()
        assert len(want) > 20 and sorted(map(str, search.second_opinion(responses, itens, produtos, k).collect())) == sorted(map(str, want))


def test_items_are_numbered_once(spark):
    """Neither the answers nor the known items read the lines again."""
    plan = registry.queries()["mat_17_second_opinion"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan
