"""The notice detail with validation, item by item; arrivals against one full run."""

import datetime as dt

from pyspark.sql import functions as F

from tendermill.operators import business, filters, matching
from tendermill.operators.overlap import OverlapIndex
from tendermill.streaming import streams

MATCH = "usuario_id long, edital_id long"


def test_validation_inside_the_detail(spark):
    itens = spark.createDataFrame(
        [(1, 1, "Papel A4 75 g/m2 com 500 folhas", 20.0, "UN"), (1, 2, "Papel A4 75 g/m2", 20.0, "UN"), (1, 3, "Caneta azul", 1.0, "UN"), (1, 4, "Fita 50 m", 5.0, "UN"), (1, 5, "Cola", 1.0, "UN")],
        "edital_id long, numero int, descricao string, valor_unitario double, unidade_medida string",
    )
    produtos = spark.createDataFrame([(7, "Papel A4 75 g/m2 500 folhas", 15.0, 1.0), (8, "Papel A4 90 g/m2", 15.0, 1.0), (9, "Caneta azul", 0.5, 1.0)], "id long, descricao string, preco_custo double, itens_por_unidade double")
    rows = [(1, 1, 1, 7, 0.9, "alta", False), (1, 1, 2, 8, 0.9, "media", True), (1, 1, 3, 9, 0.9, "alta", False), (1, 1, 4, 7, 0.9, "media", False), (1, 1, 5, 7, None, "alta", False)]
    mi = spark.createDataFrame(rows, f"{MATCH}, numero int, produto_id long, score_item double, confianca string, confirmado_manualmente boolean")
    matches = spark.createDataFrame([(1, 1)], MATCH)
    got = {r["numero"]: r for r in business.validated_detail(mi, itens, produtos, matches).collect()}
    assert {n: (r["compativel"], r["avaliacao"]) for n, r in got.items()} == {1: (True, "Atende"), 2: (True, "Não atende"), 3: (True, None), 4: (False, None), 5: (True, None)}
    assert got[2]["criticas"] == 1 and got[2]["pendencias"][0]["tipo"] == "numerico" and got[3]["pendencias"] is None
    assert got[1]["margem"] == 5.0 and got[4]["margem"] is None


def test_arrivals_equal_a_full_run(spark, tmp_path):
    """Notices in three files, one a batch: actions and alerts are those of one run over all, and the index is built once."""
    as_of = dt.date(2024, 1, 1)
    words = ["papel", "caneta", "grampo", "fita", "cola", "pasta", "mesa"]
    editais = spark.createDataFrame([(i, f"objeto {i}", dt.date(2024, 1, 1 + i % 3)) for i in range(12)], "id long, objeto string, data_encerramento date")
    itens = spark.createDataFrame([(i, n, f"{words[(i + n) % 7]} {words[(2 * i) % 7]}") for i in range(12) for n in (1, 2)], "edital_id long, numero int, descricao string")
    produtos = spark.createDataFrame([(k, k % 2, True, f"{words[k % 7]} {words[(3 * k) % 7]}") for k in range(14)], "id long, usuario_id long, ativo boolean, descricao string")
    users = spark.createDataFrame([(0,), (1,)], "id long")
    old = spark.createDataFrame([], f"{MATCH}, status string, lido boolean, interessante boolean")
    mi = spark.createDataFrame([], f"{MATCH}, confirmado_manualmente boolean")
    confirmed = spark.createDataFrame([], f"{MATCH}, numero int, produto_id long")
    excluded = spark.createDataFrame([(0, 3), (1, 4)], MATCH)
    for k in range(3):
        editais.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    built = []
    index = streams.VersionedIndex(lambda: built.append(1) or produtos, lambda: 7)
    source = streams.read_files(spark, str(tmp_path / "in"), editais.schema, 1)
    streams.match_arrivals(source, itens, produtos, users, lambda: old, mi, confirmed, lambda b: excluded, index, as_of, str(tmp_path / "out"), str(tmp_path / "check"), alerts=str(tmp_path / "alerts")).awaitTermination()
    scope = filters.matching_scope(editais, users, old, as_of)
    _, actions, _ = matching.full_matching(editais, itens, produtos, scope, excluded, old, mi, confirmed, OverlapIndex(matching.active_catalog(produtos)), full=False)
    show = lambda df: sorted(tuple(r) for r in df.filter("nivel_novo is not null").select("usuario_id", "edital_id", "nivel_novo", "score_novo", "acao", "novo_forte").collect())
    want = show(actions)
    assert show(spark.read.parquet(str(tmp_path / "out"))) == want and built == [1]
    strong = {u: sum(r[5] for r in want if r[0] == u) for u in (0, 1)}
    told = {r["usuario_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "alerts")).groupBy("usuario_id").agg(F.sum("n").alias("n")).collect()}
    assert sum(strong.values()) > 0 and told == {u: n for u, n in strong.items() if n}


def test_a_new_version_of_the_catalog_is_indexed_anew(spark):
    rows = spark.createDataFrame([(1, 1, True, "papel")], "id long, usuario_id long, ativo boolean, descricao string")
    versions = iter([1, 1, 2])
    index = streams.VersionedIndex(lambda: rows, lambda: next(versions))
    first = index()
    assert index() is first and index() is not first
