"""Agendas, reminders, document validity and ordered lists, all against an explicit day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import day_series, days_left
from .filters import by_range, by_uf, for_tenant, has_item_kind, opens_on, view_active

MATCH_ALERT = ["usuario_id", "edital_id", "nivel", "dias"]


def _notices(editais: DataFrame, *columns: str) -> DataFrame:
    return editais.select(F.col("id").alias("edital_id"), *columns)


def document_status(documentos: DataFrame, as_of: dt.date, warn: int = 15) -> DataFrame:
    days = days_left(F.col("data_validade"), as_of)
    state = F.when(days < 0, "vencido").when(days <= warn, "vence_em_breve").when(days.isNotNull(), "valido")
    return documentos.withColumns({"dias_para_vencer": days, "status": state})


def commitments(documentos: DataFrame, editais: DataFrame, matches: DataFrame, inicio: dt.date, fim: dt.date) -> DataFrame:
    """Documents that expire and tracked notices that open in a range."""
    d = by_range(documentos.filter("ativo"), "data_validade", inicio, fim).select("usuario_id", F.lit("documento").alias("tipo"), F.col("data_validade").alias("data"), F.col("id").alias("ref"))
    e = by_range(editais, "data_abertura", inicio, fim).select(F.col("id").alias("edital_id"), "data_abertura")
    m = matches.filter("status = 'vou_participar'").join(e, "edital_id").select("usuario_id", F.lit("edital").alias("tipo"), F.col("data_abertura").alias("data"), F.col("edital_id").alias("ref"))
    return d.unionByName(m)


def distinct_days(df: DataFrame, day: str = "data") -> DataFrame:
    return df.select("usuario_id", day).distinct()


def agenda(editais: DataFrame, matches: DataFrame, usuario_id: int, as_of: dt.date, offset: int = 0) -> DataFrame:
    """The seven days of a week from Sunday, with the tenant's notices that open on each."""
    sunday = as_of - dt.timedelta(days=(as_of.weekday() + 1) % 7) + dt.timedelta(days=7 * offset)
    days = day_series(editais.sparkSession, sunday, 7)
    e = by_range(editais, "data_abertura", sunday, sunday + dt.timedelta(days=6)).select(F.col("id").alias("edital_id"), F.col("data_abertura").alias("data"))
    mine = for_tenant(matches, usuario_id).join(e, "edital_id").groupBy("data").agg(F.count("*").alias("sessoes"))
    return F.broadcast(days).join(mine, "data", "left").select("data", F.coalesce("sessoes", F.lit(0)).alias("sessoes"), F.col("sessoes").isNotNull().alias("tem_sessao"), (F.col("data") == F.lit(as_of)).alias("hoje"))


def opening_alerts(matches: DataFrame, editais: DataFrame, usuarios: DataFrame, as_of: dt.date) -> DataFrame:
    """Strong matches not yet announced that open within each tenant's own days."""
    u = usuarios.filter("ativo and avisar_abertura").select(F.col("id").alias("usuario_id"), F.greatest("dias_antecedencia", F.lit(0)).alias("limite"))
    rows = matches.filter("nivel = 'forte' and not avisado_abertura").join(u, "usuario_id").join(_notices(editais, "data_abertura"), "edital_id")
    rows = rows.withColumn("dias", days_left(F.col("data_abertura"), as_of))
    return rows.filter("dias >= 0 and dias <= limite").select(*MATCH_ALERT)


def closing_alerts(matches: DataFrame, editais: DataFrame, usuarios: DataFrame, as_of: dt.date, days: int = 2) -> DataFrame:
    u = usuarios.filter("ativo").select(F.col("id").alias("usuario_id"))
    soon = by_range(editais, "data_encerramento", as_of, as_of + dt.timedelta(days=days))
    rows = matches.filter("(interessante or nivel = 'forte') and not avisado_prazo").join(u, "usuario_id", "left_semi").join(_notices(soon, "data_encerramento"), "edital_id")
    return rows.withColumn("dias", days_left(F.col("data_encerramento"), as_of)).select(*MATCH_ALERT)


def document_alerts(documentos: DataFrame, usuarios: DataFrame, as_of: dt.date, days: int = 15) -> DataFrame:
    """Documents near or past their end whose current date was not announced yet."""
    u = usuarios.filter("ativo").select(F.col("id").alias("usuario_id"))
    rows = documentos.filter("ativo").join(u, "usuario_id", "left_semi").withColumn("dias", days_left(F.col("data_validade"), as_of))
    return rows.filter((F.col("dias") <= days) & ~F.col("avisado_para").eqNullSafe(F.col("data_validade"))).select("usuario_id", F.col("id").alias("documento_id"), "dias")


def mark_sent(table: DataFrame, sent: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """``table`` with ``flag`` set for the keys that were sent."""
    done = sent.select(*keys).distinct().withColumn("__s", F.lit(True))
    return table.join(done, keys, "left").withColumn(flag, F.coalesce("__s", F.col(flag))).drop("__s")


def pending_counts(matches: DataFrame, editais: DataFrame, documentos: DataFrame, usuarios: DataFrame, as_of: dt.date) -> DataFrame:
    """Pending alerts of each tenant in four categories."""
    strong = view_active(matches.filter("nivel = 'forte' and not lido").join(_notices(editais, "data_abertura"), "edital_id"), as_of)
    parts = {
        "forte": strong, "prazo": closing_alerts(matches, editais, usuarios, as_of), "abertura": opening_alerts(matches, editais, usuarios, as_of),
        "documento": document_alerts(documentos, usuarios, as_of),
    }
    rows = None
    for name, df in parts.items():
        one = df.select("usuario_id", F.lit(name).alias("categoria"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("usuario_id", "categoria").agg(F.count("*").alias("n"))


def listing_order(view: str = "ativos") -> list[Column]:
    if view == "encerrados":
        return [F.col("data_abertura").desc_nulls_first(), F.col("edital_id")]
    return [F.desc("score"), F.col("data_abertura").asc_nulls_last(), F.col("edital_id")]


def page(df: DataFrame, n: int, size: int) -> DataFrame:
    return df.offset((n - 1) * size).limit(size)


def recent(matches: DataFrame, limit: int = 5, by: str = "interagido_em") -> DataFrame:
    """Each tenant's matches touched last, 1 to 20 of them."""
    limit = max(1, min(20, limit))
    order = Window.partitionBy("usuario_id").orderBy(F.desc(by), "edital_id")
    return matches.filter(F.col(by).isNotNull()).withColumn("posicao", F.row_number().over(order)).filter(F.col("posicao") <= limit)


def last_runs(logs: DataFrame, ts: str, tie: str, n: int = 30) -> DataFrame:
    return logs.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def last_finished(logs: DataFrame, group: str, ts: str) -> DataFrame:
    return logs.groupBy(group).agg(F.max(ts).alias("fim"))


def seconds_since_end(logs: DataFrame, group: str, ts: str, now: dt.datetime) -> DataFrame:
    """``last_finished`` with the whole seconds (``segundos``) from the last end to ``now``."""
    passed = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("fim").cast("timestamp"))
    return last_finished(logs, group, ts).withColumn("segundos", F.floor(passed / 1_000_000).cast("long"))


def search_unmatched(editais: DataFrame, itens: DataFrame, matches: DataFrame, usuario_id: int, term: str, as_of: dt.date, ufs=None, kind=None, n: int = 20, valor: tuple | None = None, today: bool = False, view: str = "ativos") -> DataFrame:
    """The newest notices with the term in an item and without a match of the tenant, each with up to 3 of those descriptions.

    ``valor`` are the least and the largest estimate (each may be null); ``today`` keeps those that open on ``as_of``.
    Only the view ``ativos`` leaves out notices that have opened; every other view searches all.
    """
    hits = itens.filter(F.contains(F.lower("descricao"), F.lit(term.strip().lower())))
    e = by_uf(editais, ufs) if valor is None else by_range(by_uf(editais, ufs), "valor_estimado", *valor)
    e = opens_on(e, as_of) if today else e
    e = (view_active(e, as_of) if view == "ativos" else e).withColumnRenamed("id", "edital_id")
    e = has_item_kind(e, itens, kind).join(hits.select("edital_id"), "edital_id", "left_semi").join(for_tenant(matches, usuario_id).select("edital_id"), "edital_id", "left_anti")
    top = e.orderBy(F.desc("coletado_em"), F.desc("edital_id")).limit(n)
    some = hits.join(F.broadcast(top.select("edital_id")), "edital_id", "left_semi").groupBy("edital_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("numero", "descricao"))), 1, 3).alias("s"))
    return top.join(some, "edital_id").select("edital_id", "uf", F.array_join(F.transform("s", lambda x: x["descricao"]), " | ").alias("amostra"))


def ordered_items(itens: DataFrame) -> DataFrame:
    return itens.orderBy("edital_id", "numero")


def list_suppliers(fornecedores: DataFrame, usuario_id: int) -> DataFrame:
    return for_tenant(fornecedores, usuario_id).filter("ativo").orderBy("nome", "id")


def list_documents(documentos: DataFrame, usuario_id: int) -> DataFrame:
    return for_tenant(documentos, usuario_id).orderBy(F.col("data_validade").asc_nulls_last(), "id")


def list_products(produtos: DataFrame, usuario_id: int, n: int = 1, size: int = 50) -> DataFrame:
    return page(for_tenant(produtos, usuario_id).orderBy(F.desc("id")), n, size)


