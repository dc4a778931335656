"""Streams that meet tables written by others, stop half way, and leave alerts."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tendermill.operators import business, matching, tables
from tendermill.sources import notices
from tendermill.operators.overlap import overlap_scorer
from tendermill.streaming import streams

MATCH = "usuario_id long, edital_id long"


def landed(spark, path, ids, files=1):
    spark.createDataFrame([(i, "T", f"x{i}") for i in ids], "id long, fonte string, id_externo string").repartition(files).write.mode("append").parquet(str(path))
    return streams.read_files(spark, str(path), "id long, fonte string, id_externo string", 1)


def ids(spark, table):
    return sorted(r["id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(table).select("id").collect())


def test_a_new_checkpoint_on_an_old_table(spark, tmp_path):
    table = str(tmp_path / "table")
    streams.ingest_stream(landed(spark, tmp_path / "a", range(6)), table, str(tmp_path / "c1")).awaitTermination()
    streams.ingest_stream(landed(spark, tmp_path / "b", [5, 10, 10]), table, str(tmp_path / "c2")).awaitTermination()
    assert ids(spark, table) == [0, 1, 2, 3, 4, 5, 10]
    # the first stream goes on, and finds what the second one brought
    streams.ingest_stream(landed(spark, tmp_path / "a", [10, 11, 0]), table, str(tmp_path / "c1")).awaitTermination()
    assert ids(spark, table) == [0, 1, 2, 3, 4, 5, 10, 11]


def test_a_stopped_recompute_goes_on(spark, tmp_path):
    source = landed(spark, tmp_path / "in", range(40), 4)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    seen = []

    def match(batch):
        seen.append(sorted(r["id"] for r in batch.select("id").collect()))
        if len(seen) == 3:
            raise ValueError("stopped")
        return batch.select("id")

    with pytest.raises(StreamingQueryException):
        streams.resumable_recompute(source, match, out, check).awaitTermination()
    assert streams.recompute_progress(spark, out).count() == 2
    streams.resumable_recompute(source, match, out, check).awaitTermination()
    assert ids(spark, out) == list(range(40)) and len(seen) == 5 and seen[3] == seen[2]
    assert streams.recompute_progress(spark, out).agg(F.sum("n")).first()[0] == 40
    assert streams.recompute_progress(spark, str(tmp_path / "none")).count() == 0


def test_alerts_of_new_strong_matches(spark, tmp_path):
    source = landed(spark, tmp_path / "in", [1, 2, 3])

    def match(batch):
        return batch.select((F.col("id") % 2).alias("usuario_id"), F.col("id").alias("edital_id"), (F.col("id") > 1).alias("novo_forte"))

    streams.match_stream(source, match, str(tmp_path / "m"), str(tmp_path / "c"), str(tmp_path / "alerts")).awaitTermination()
    got = {(r["usuario_id"], r["n"], r["editais"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert got == {(0, 1, "2"), (1, 1, "3")}


def plain_limiter(attempts, limit, window):
    out, alive = [], []
    for t, clear in attempts:
        if clear:
            alive = []
            continue
        alive = [a for a in alive if t - a < window]
        out.append((t, len(alive) < limit))
        if len(alive) < limit:
            alive.append(t)
    return out


def test_limiter_equals_a_plain_walk(spark):
    """Whole, and in pieces that carry only the admitted attempts in the window, as the stream does."""
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(seconds=s), s % 70 == 0) for k in (1, 2) for s in range(0, 400, 10 * k)]
    want = sorted((k, t, ok) for k in (1, 2) for t, ok in plain_limiter([((ts - start).seconds, c) for key, ts, c in rows if key == k], 3, 60))
    whole = streams.attempt_limiter(spark.createDataFrame(rows, "chave long, ts timestamp, limpa boolean"), 3, 60)
    assert sorted((r["chave"], (r["ts"] - start).seconds, r["admitido"]) for r in whole.collect()) == want
    pieces, alive = [], []
    own = [((ts - start).seconds, c) for key, ts, c in rows if key == 1]
    for at in range(0, len(own), 7):
        some = own[at : at + 7]
        out, alive = streams.admit([float(t) for t, _ in some], [c for _, c in some], alive, 3, 60)
        pieces += [(1, int(t), ok) for t, ok, _ in out]
    assert sorted(pieces) == [w for w in want if w[0] == 1]


def test_the_latest_confirmation_holds(spark):
    c = spark.createDataFrame([(1, 1, 1, 7, 1), (1, 1, 1, None, 2), (1, 1, 2, 7, 5), (1, 1, 2, 8, 3)], f"{MATCH}, numero int, produto_id long, em int")
    itens = spark.createDataFrame([(1, 1), (1, 2)], "edital_id long, numero int")
    produtos = spark.createDataFrame([(1, 7), (1, 8)], "usuario_id long, id long")
    m = spark.createDataFrame([], f"{MATCH}, score double, nivel string")
    mi = spark.createDataFrame([(1, 1, 1, 9, 0.4, "media", False)], f"{MATCH}, numero int, produto_id long, score_item double, confianca string, confirmado_manualmente boolean")
    _, items, rejects = tables.confirm_items(m, mi, c, itens, produtos)
    assert {(r["numero"], r["produto_id"], r["score_item"], r["confirmado_manualmente"]) for r in items.collect()} == {(1, None, 0.0, True), (2, 7, 1.0, True)}
    assert items.count() == 2 and rejects.count() == 0


@pytest.mark.parametrize(("full", "want"), [(True, {1: "apagar", 2: "manter", 3: "ignorar", 4: "criar"}), (False, {1: "manter", 2: "manter", 3: "ignorar", 4: "criar"})])
def test_exclusion_comes_first(spark, full, want):
    old = spark.createDataFrame([(1, 1, "novo", False, False), (1, 2, "novo", False, False)], f"{MATCH}, status string, lido boolean, interessante boolean")
    mi = spark.createDataFrame([], f"{MATCH}, confirmado_manualmente boolean")
    fresh = spark.createDataFrame([(1, 3, "forte", 0.9), (1, 4, "forte", 0.9)], f"{MATCH}, nivel string, score double")
    excluded = spark.createDataFrame([(1, 1), (1, 3)], MATCH)
    assert {r["edital_id"]: r["acao"] for r in matching.lifecycle(old, mi, fresh, excluded, full).collect()} == want


def test_matching_of_texts(spark):
    editais = spark.createDataFrame([(1, "papel"), (2, "x")], "id long, objeto string")
    itens = spark.createDataFrame([(1, 1, "papel a4", "10", None), (1, 2, "caneta azul", None, None), (2, 1, "nada", None, None)], "edital_id long, numero int, descricao string, ncm string, catalogo_codigo string")
    produtos = spark.createDataFrame([(5, 1, "papel a4", True), (6, 1, "papel", True), (7, 1, "caneta", True), (8, 2, "nada", True), (9, 1, "papel a4", False)], "id long, usuario_id long, descricao string, ativo boolean")
    scope = spark.createDataFrame([(1, 1), (1, 2)], MATCH)
    items = matching.targets(editais, itens)
    index = spark.createDataFrame([(1, "ncm", "10", 6)], "usuario_id long, tipo string, codigo string, produto_id long")
    live = produtos.filter("ativo")
    by_text = {(r["edital_id"], r["numero"]): r for r in matching.match_items(scope, items, live, overlap_scorer).collect()}
    assert (by_text[1, 1]["produto_id"], by_text[1, 1]["score"], by_text[1, 1]["segundo"]) == (5, 1.0, 0.5)
    assert [c["produto_id"] for c in by_text[1, 1]["candidatos"]] == [5, 6] and by_text[2, 1]["produto_id"] is None
    coded = {(r["edital_id"], r["numero"]): r for r in matching.match_items(scope, items, live, overlap_scorer, index).collect()}
    assert (coded[1, 1]["produto_id"], coded[1, 1]["score"], coded[1, 1]["segundo"], coded[1, 1]["motivo"]) == (6, 1.0, 1.0, "código NCM 10")
    assert len(coded) == 3 and coded[1, 2]["produto_id"] == 7
    scores = matching.catalog_scores(scope, items, live, overlap_scorer)
    assert scores.count() == 9 and scores.filter("numero = 1 and edital_id = 1 and produto_id = 6").first()["score"] == 0.5


def test_zips_are_opened(spark):
    import io
    import zipfile

    def zipped(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, "x")
        return out.getvalue()

    rows = [(1, zipped("word/document.xml", "a")), (2, zipped("a.pdf")), (3, b"%PDF"), (4, b"PK\x03\x04broken"), (5, None), (6, bytes.fromhex("D0CF11E0A1B11AE1"))]
    got = {r["id"]: r["rota"] for r in notices.route_files(spark.createDataFrame(rows, "id int, content binary")).collect()}
    assert got == {1: "docx", 2: "zip", 3: "pdf", 4: "zip", 5: "pdf", 6: "ole2"}


def test_quotations_of_a_selection(spark):
    mi = spark.createDataFrame([(1, 1, n, 7, "alta", False) for n in (1, 2)], f"{MATCH}, numero int, produto_id long, confianca string, confirmado_manualmente boolean")
    itens = spark.createDataFrame([(1, 1, 4.0, 9.0), (1, 2, 0.0, 9.0)], "edital_id long, numero int, quantidade double, valor_unitario double")
    produtos = spark.createDataFrame([(7, 2.0, 3.0, 1.0)], "id long, preco_custo double, preco_venda double, itens_por_unidade double")
    freight = spark.createDataFrame([(1, 1, 1, 6.0, 2.0), (1, 1, 2, 6.0, None)], f"{MATCH}, numero int, frete_entrada double, frete_saida double")
    matches = spark.createDataFrame([(1, 1), (1, 2)], MATCH)
    rows, empty = business.selected_quotation(mi, itens, produtos, freight, mi.filter("numero = 1"), matches)
    assert [(r["numero"], r["frete_unitario"], r["custo_total_unitario"], r["total"]) for r in rows.collect()] == [(1, 2.0, 4.0, 16.0)]
    assert [r["edital_id"] for r in empty.collect()] == [2]
