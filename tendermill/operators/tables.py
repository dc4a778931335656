"""New snapshots of mutable tables: upserts, deletes, prunes, backfills, exports. Each function returns what the table becomes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import clip, digits
from .filters import MATCH_KEY, view_active


def _first(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def insert_if_absent(old: DataFrame, batch: DataFrame, order: list[str], key: tuple[str, ...] = ("fonte", "id_externo")) -> DataFrame:
    """``old`` and the rows of ``batch`` with a new key, the first of each by ``order``."""
    fresh = _first(batch, list(key), *order).join(old.select(*key), list(key), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def upsert_catalog(old: DataFrame, batch: DataFrame, row: str, values: list[str]) -> DataFrame:
    """The catalog after rows of ``batch`` in the order of ``row``: same tenant and description (in any case) is the same product.

    Only values that are not null overwrite. Adds ``acao``: criado, atualizado or igual.
    """
    keyed = lambda df: df.withColumn("__k", F.lower(F.trim("descricao")))
    fold = keyed(batch).groupBy("usuario_id", "__k").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row))).alias(f"__{c}") for c in ["descricao", *values]])
    both = keyed(old).join(fold, ["usuario_id", "__k"], "full_outer")
    action = F.when(F.col("descricao").isNull(), "criado").when(F.col("__descricao").isNull(), "igual").otherwise("atualizado")
    return both.select(
        "id", "usuario_id", F.coalesce("__descricao", "descricao").alias("descricao"), *[F.coalesce(f"__{c}", c).alias(c) for c in values], action.alias("acao")
    )


def link_suppliers(batch: DataFrame, suppliers: DataFrame) -> DataFrame:
    """``batch`` with the supplier whose phone or ``whatsapp`` (if there is one) has the same digits (of several the largest id); ``erro`` where none has."""
    numbers = F.array(*[digits(F.col(c)) for c in ("telefone", "whatsapp") if c in suppliers.columns])
    phones = suppliers.select("usuario_id", F.col("id").alias("fornecedor_id"), F.col("nome").alias("fornecedor_nome"), F.explode(numbers).alias("__d")).filter("__d <> ''")
    phones = _first(phones, ["usuario_id", "__d"], F.desc("fornecedor_id"))
    own = batch.withColumn("__d", digits(F.col("telefone")))
    return own.join(phones, ["usuario_id", "__d"], "left").withColumn("erro", (F.col("__d") != "") & F.col("fornecedor_id").isNull()).drop("__d")


def fill_suppliers(suppliers: DataFrame, linked: DataFrame, row: str, values: tuple[str, ...] = ("nome", "contato", "site")) -> DataFrame:
    """Suppliers with empty ``values`` filled from the linked rows (``fornecedor_id`` and the values) that have one, the last by ``row``."""
    given = {c: F.nullif(F.trim(c), F.lit("")) for c in values}
    fold = linked.groupBy("fornecedor_id").agg(*[F.max_by(given[c], F.when(given[c].isNotNull(), F.col(row))).alias(f"__{c}") for c in values])
    both = suppliers.join(fold.withColumnRenamed("fornecedor_id", "id"), "id", "left")
    return both.withColumns({c: F.coalesce(given[c], f"__{c}") for c in values}).drop(*[f"__{c}" for c in values])


def drop_product_references(matches: DataFrame, match_itens: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches and their items without the products of ``gone`` (``usuario_id, produto_id``); a match left without items goes."""
    keys = ["usuario_id", "produto_id"]
    kept = match_itens.join(gone.select(*keys), keys, "left_anti")
    touched = match_itens.join(gone.select(*keys), keys, "left_semi").select(*MATCH_KEY).distinct()
    counts = kept.groupBy(*MATCH_KEY).agg(F.count("*").alias("itens_compativeis"))
    emptied = touched.join(counts, MATCH_KEY, "left_anti")
    return matches.join(emptied, MATCH_KEY, "left_anti").join(counts, MATCH_KEY, "left"), kept


def purge_logs(logs: DataFrame, ts: str, as_of: dt.date, days: int = 15) -> DataFrame:
    return logs.filter(F.col(ts) >= F.lit(as_of - dt.timedelta(days=days)))


def prune_orphans(editais: DataFrame, itens: DataFrame, used: list[DataFrame], as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Notices and items without those that opened before ``as_of`` and that no table of ``used`` (``edital_id``) names."""
    orphans = editais.filter(F.col("data_abertura") < F.lit(as_of)).select("id")
    for table in used:
        orphans = orphans.join(table.select(F.col("edital_id").alias("id")), "id", "left_anti")
    return editais.join(orphans, "id", "left_anti"), itens.join(orphans.withColumnRenamed("id", "edital_id"), "edital_id", "left_anti")


def purge_weak(matches: DataFrame, usuario_id: int | None = None) -> DataFrame:
    weak = F.col("nivel") == "fraco"
    return matches.filter(~(weak if usuario_id is None else weak & (F.col("usuario_id") == usuario_id)))


def backfill_unit(itens: DataFrame, found: DataFrame) -> DataFrame:
    """``itens`` with ``unidade_medida`` from ``found`` (``edital_id, numero, unidade_medida``) where it is null."""
    new = found.select("edital_id", "numero", F.nullif("unidade_medida", F.lit("")).alias("__u"))
    return itens.join(new, ["edital_id", "numero"], "left").withColumn("unidade_medida", F.coalesce("unidade_medida", "__u")).drop("__u")


def backfill_scope(editais: DataFrame, itens: DataFrame, matches: DataFrame, as_of: dt.date, tracked: list[str]) -> DataFrame:
    """Notices with an item without a unit that are active or tracked by somebody."""
    lacking = itens.filter("unidade_medida is null").select(F.col("edital_id").alias("id")).distinct()
    followed = matches.filter(F.col("status").isin(tracked)).select(F.col("edital_id").alias("id"))
    wanted = view_active(editais, as_of).select("id").unionByName(followed).distinct()
    return editais.join(lacking, "id", "left_semi").join(wanted, "id", "left_semi")


def apply_descriptions(itens: DataFrame, completed: DataFrame) -> DataFrame:
    """``itens`` with completed descriptions where given and different; ``mudou`` tells which."""
    new = completed.select("edital_id", "numero", F.nullif(F.trim("descricao_completa"), F.lit("")).alias("__d"))
    changed = F.col("__d").isNotNull() & ~F.col("__d").eqNullSafe(F.col("descricao"))
    return itens.join(new, ["edital_id", "numero"], "left").withColumn("mudou", changed).withColumn("descricao", F.coalesce("__d", "descricao")).drop("__d")


def stamp_completed(editais: DataFrame, results: DataFrame, now: dt.datetime) -> DataFrame:
    """``editais`` with ``completado_em``: ``now`` where a result (``edital_id, status``) is ok, else what it was."""
    done = results.filter("status = 'ok'").select(F.col("edital_id").alias("id")).distinct().withColumn("__ok", F.lit(True))
    before = F.col("completado_em") if "completado_em" in editais.columns else F.lit(None).cast("timestamp")
    return editais.join(done, "id", "left").withColumn("completado_em", F.when(F.col("__ok"), F.lit(now)).otherwise(before)).drop("__ok")


def write_csv(rows: DataFrame, path: str) -> None:
    """The CSV sink of the exports: ``;`` between columns, a header in every file, rows in the order of ``rows`` from file to file."""
    rows.write.option("sep", ";").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


# The columns of the exports, in order.
MATCH_COLUMNS = ["nivel", "score", "itens_compativeis", "orgao", "uf", "municipio", "modalidade", "valor_estimado", "data_encerramento", "objeto", "link"]
CATALOG_COLUMNS = [
    "descricao", "palavras_chave", "ncm", "ean", "catmat", "catser", "fabricante", "marca", "modelo", "preco_custo", "preco_venda", "unidade_venda",
    "itens_por_unidade", "fornecedor_telefone", "fornecedor_nome", "fornecedor_contato", "fornecedor_site",
]


def _with_all(df: DataFrame, columns: list[str]) -> list[Column]:
    """``columns`` of ``df``; those that it lacks are null texts."""
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]


def export_matches(matches: DataFrame, editais: DataFrame, nivel: str | None = None) -> DataFrame:
    """The export of matches, each tenant's best first: ``usuario_id``, then ``MATCH_COLUMNS``; the object is cut at 300 signs."""
    rows = matches if nivel is None else matches.filter(F.col("nivel") == nivel)
    notice = [c for c in MATCH_COLUMNS if c in editais.columns]
    e = editais.select(F.col("id").alias("edital_id"), *notice).withColumn("objeto", clip(F.coalesce("objeto", F.lit("")), 300))
    both = rows.drop(*notice).join(e, "edital_id").orderBy("usuario_id", F.desc("score"), "edital_id")
    return both.select("usuario_id", *_with_all(both, MATCH_COLUMNS))


def export_catalog(produtos: DataFrame, fornecedores: DataFrame) -> DataFrame:
    """The export of catalogs: ``usuario_id``, then ``CATALOG_COLUMNS`` by description; a product without a supplier has an empty phone."""
    phones = fornecedores.select(F.col("id").alias("fornecedor_id"), F.coalesce("telefone", F.lit("")).alias("fornecedor_telefone"))
    both = produtos.drop("fornecedor_telefone").join(phones, "fornecedor_id", "left").withColumn("fornecedor_telefone", F.coalesce("fornecedor_telefone", F.lit("")))
    both = both.orderBy("usuario_id", "descricao", "id")
    return both.select("usuario_id", *_with_all(both, CATALOG_COLUMNS))


def run_log(batch: DataFrame, group: str) -> DataFrame:
    """One row for each value of ``group`` with what a run saw, added and found strong (``novo``, ``nivel``)."""
    return batch.groupBy(group).agg(F.count("*").alias("vistos"), F.count_if("novo").alias("novos"), F.count_if(F.col("novo") & (F.col("nivel") == "forte")).alias("fortes"))


def run_log_by_source(batch: DataFrame, errors: DataFrame, source: str = "fonte") -> DataFrame:
    """``run_log`` for each source, those that only failed too, with the first 500 characters of its error (``source, erro``; of several the least)."""
    failed = errors.groupBy(source).agg(F.min("erro").alias("erro"))
    rows = run_log(batch, source).join(failed, source, "full_outer")
    return rows.fillna(0, ["vistos", "novos", "fortes"]).withColumn("erro", clip(F.col("erro"), 500))


#: So many sources, with four counts each, are observed in one write.
MAX_OBSERVED = 200


def write_observed(rows: DataFrame, path: str, metrics: dict[str, Column]) -> dict:
    """Writes ``rows`` over the Parquet folder ``path`` and returns aggregates of them (``name: aggregate``), taken by the write itself."""
    seen = Observation()
    rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def write_with_log(batch: DataFrame, path: str, sources: list[str], errors: DataFrame, source: str = "fonte") -> DataFrame:
    """Writes a run's rows and returns ``run_log_by_source`` of them, with no other scan and no shuffle of the rows.

    ``sources`` are all that a run asks, up to ``MAX_OBSERVED`` of them; a row of any other source, or of none, is a ValueError once all is
    written. ``errors`` as in ``run_log_by_source``.
    """
    names = list(dict.fromkeys(sources))
    if len(names) > MAX_OBSERVED:
        raise ValueError(f"at most {MAX_OBSERVED} sources are observed; use run_log_by_source")
    strong, metrics = F.col("novo") & (F.col("nivel") == "forte"), {"todos": F.count(F.lit(1))}
    for i, name in enumerate(names):
        own = F.col(source) == name
        metrics |= {f"vistos_{i}": F.count_if(own), f"novos_{i}": F.count_if(own & F.col("novo")), f"fortes_{i}": F.count_if(own & strong)}
    seen = write_observed(batch, path, metrics)
    counts = [(name, *[seen[f"{m}_{i}"] for m in ("vistos", "novos", "fortes")]) for i, name in enumerate(names)]
    if sum(c[1] for c in counts) != seen["todos"]:
        raise ValueError("the batch has rows of sources that were not named")
    log = batch.sparkSession.createDataFrame([c for c in counts if c[1]], f"{source} string, vistos long, novos long, fortes long")
    failed = errors.groupBy(source).agg(F.min("erro").alias("erro"))
    rows = log.join(failed, source, "full_outer")
    return rows.fillna(0, ["vistos", "novos", "fortes"]).withColumn("erro", clip(F.col("erro"), 500))


def outbox(alerts: DataFrame, kind: str, channel: str) -> DataFrame:
    """One message for each tenant: ``n`` and the notices in order."""
    return alerts.groupBy("usuario_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("edital_id")), ",").alias("editais")).withColumns({"tipo": F.lit(kind), "canal": F.lit(channel)})


def latest_confirmation(confirmations: DataFrame) -> DataFrame:
    """One confirmation of each item: the latest by ``em``, where there is such a column; ties go to the largest product, "none of these" last."""
    order = [F.col(c) for c in ("em", "produto_id") if c in confirmations.columns]
    best = confirmations.groupBy(*MATCH_KEY, "numero").agg(F.max(F.struct(*order)).alias("__b"))
    return best.select(*MATCH_KEY, "numero", F.col("__b.produto_id").alias("produto_id"))


def confirm_items(matches: DataFrame, match_itens: DataFrame, confirmations: DataFrame, itens: DataFrame, produtos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches, their items and rejects after confirmations by hand (``usuario_id, edital_id, numero, produto_id``).

    A null product is "none of these". Unknown items and products of another tenant are rejected; of what is left the latest confirmation
    of an item holds (``latest_confirmation``). A missing match is made with score 0 and ``medio``; a missing item is appended. A
    confirmed item scores 1, and 0 if it is none of the catalog's.
    """
    item_key = [*MATCH_KEY, "numero"]
    known_item = itens.select("edital_id", "numero").withColumn("__i", F.lit(True))
    known_product = produtos.select("usuario_id", F.col("id").alias("produto_id")).withColumn("__p", F.lit(True))
    checked = confirmations.join(known_item, ["edital_id", "numero"], "left").join(known_product, ["usuario_id", "produto_id"], "left")
    fine = F.col("__i").isNotNull() & (F.col("produto_id").isNull() | F.col("__p").isNotNull())
    good = latest_confirmation(checked.filter(fine)).withColumnRenamed("produto_id", "novo_produto")
    both = match_itens.join(good.withColumn("__c", F.lit(True)), item_key, "full_outer")
    new_items = both.select(
        *item_key, F.when(F.col("__c"), F.col("novo_produto")).otherwise(F.col("produto_id")).alias("produto_id"),
        F.when(F.col("__c"), F.col("novo_produto").isNotNull().cast("double")).otherwise(F.col("score_item")).alias("score_item"), "confianca",
        F.coalesce(F.col("__c"), F.col("confirmado_manualmente"), F.lit(False)).alias("confirmado_manualmente"),
    )
    made = good.select(*MATCH_KEY).distinct().join(matches.select(*MATCH_KEY), MATCH_KEY, "left_anti").withColumns({"score": F.lit(0.0), "nivel": F.lit("medio")})
    rejects = checked.filter(~fine).select(*item_key, "produto_id")
    return matches.unionByName(made, allowMissingColumns=True), new_items, rejects


STATUSES = ["novo", "vou_participar", "proposta_enviada", "ganho", "perdido", "descartado"]


def apply_flags(matches: DataFrame, changes: DataFrame) -> DataFrame:
    """Matches after flag and status changes (``usuario_id, edital_id, em, lido, interessante, status``), the latest of each value; unknown states are left out."""
    valid = changes.withColumn("status", F.when(F.col("status").isin(STATUSES), F.col("status")))
    names = ["lido", "interessante", "status"]
    fold = valid.groupBy(*MATCH_KEY).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("em"))).alias(f"__{c}") for c in names])
    both = matches.join(fold, MATCH_KEY, "full_outer")
    default = {"lido": F.lit(False), "interessante": F.lit(False), "status": F.lit("novo")}
    return both.withColumns({c: F.coalesce(f"__{c}", c, default[c]) for c in names}).drop(*[f"__{c}" for c in names])


def stale_cache(cache: DataFrame, versions: DataFrame, force: bool = False) -> DataFrame:
    """Cache rows (``usuario_id, edital_id, versao_calc``) with ``desatualizado`` and ``calcular``, against each tenant's version."""
    both = cache.join(versions.select("usuario_id", "versao"), "usuario_id", "left")
    never = F.col("versao_calc").isNull()
    return both.withColumn("desatualizado", ~never & (F.col("versao_calc") != F.col("versao"))).withColumn("calcular", never | F.lit(force))


def store_cache(computed: DataFrame, versions: DataFrame, value: str = "valor") -> DataFrame:
    """Cache rows of what was computed (``usuario_id, edital_id`` and the value): nothing found is stored as null, with the tenant's version, so it is not asked again."""
    own = versions.select("usuario_id", F.col("versao").alias("versao_calc"))
    return computed.withColumn(value, F.nullif(F.trim(value), F.lit(""))).join(own, "usuario_id", "left")


def bump_versions(versions: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("usuario_id").agg(F.count("*").alias("__n"))
    return versions.join(counts, "usuario_id", "left").withColumn("versao", F.col("versao") + F.coalesce("__n", F.lit(0))).drop("__n")
