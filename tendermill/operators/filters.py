"""Predicates of the notice listing and of matching, as DataFrame filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .terms import term_hits

#: States of a match that its tenant took part in, whatever came of it (fixed values).
TRACKED = ["proposta_enviada", "ganho", "perdido"]
MATCH_KEY = ["usuario_id", "edital_id"]


def by_flags(df: DataFrame, nivel: str | None = None, status: str | None = None, unread: bool = False, interesting: bool = False) -> DataFrame:
    for column, value in (("nivel", nivel), ("status", status)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if unread:
        df = df.filter(~F.col("lido"))
    return df.filter("interessante") if interesting else df


def by_uf(df: DataFrame, ufs: Sequence[str] | None) -> DataFrame:
    return df.filter(F.upper("uf").isin([u.upper() for u in ufs])) if ufs else df


def opens_on(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.filter(F.col("data_abertura") == F.lit(as_of))


def by_range(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    """Both ends count; a null never passes a bound that is set."""
    if lo is not None:
        df = df.filter(F.col(column) >= F.lit(lo))
    return df.filter(F.col(column) <= F.lit(hi)) if hi is not None else df


def has_item_kind(df: DataFrame, itens: DataFrame, kind: str | None) -> DataFrame:
    """Notices (``edital_id``) with an item whose kind starts with the letter ``kind``."""
    if not kind:
        return df
    hits = itens.filter(F.lower(F.substring(F.coalesce("material_ou_servico", F.lit("")), 1, 1)) == kind.lower()).select("edital_id")
    return df.join(hits, "edital_id", "left_semi")


def has_item_text(df: DataFrame, itens: DataFrame, term: str | None) -> DataFrame:
    """Notices with an item whose description holds the term literally, in any case; a blank term holds for all."""
    term = (term or "").strip().lower()
    if not term:
        return df
    return df.join(itens.filter(F.contains(F.lower("descricao"), F.lit(term))).select("edital_id"), "edital_id", "left_semi")


def view_active(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.filter(F.col("data_abertura").isNull() | (F.col("data_abertura") >= F.lit(as_of)))


def view_closed(df: DataFrame, as_of: dt.date) -> DataFrame:
    return df.filter((F.col("data_abertura") < F.lit(as_of)) & F.col("status").isin(TRACKED))


def for_tenant(df: DataFrame, usuario_id: int) -> DataFrame:
    return df.filter(F.col("usuario_id") == usuario_id)


def list_notices(matches: DataFrame, editais: DataFrame, itens: DataFrame, usuario_id: int | None, as_of: dt.date, *, view: str = "ativos", ufs=None, kind=None, term=None, valor=(None, None), abertura=(None, None), opens_today=False, **flags) -> DataFrame:
    """Matches joined to their notices under all given predicates; filters on notices come before the join."""
    notices = by_range(by_range(by_uf(editais, ufs), "valor_estimado", *valor), "data_abertura", *abertura)
    if opens_today:
        notices = opens_on(notices, as_of)
    notices = notices.withColumnRenamed("id", "edital_id")
    notices = has_item_text(has_item_kind(notices, itens, kind), itens, term)
    mine = by_flags(matches if usuario_id is None else for_tenant(matches, usuario_id), **flags)
    both = mine.join(notices, "edital_id")
    return view_closed(both, as_of) if view == "encerrados" else view_active(both, as_of)


#: Values in a block of a small side, and blocks that are broadcast at most (under 2 MB); more of them are joined by shuffle.
BLOCK, MAX_BROADCAST_BLOCKS = 1_000, 50


def _with_blocks(rows: DataFrame, values: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the values of a counted table as arrays ``name`` of about ``BLOCK`` each, a row for each array."""
    n = max(1, -(-values.count() // BLOCK))
    blocks = values.groupBy(F.pmod(F.xxhash64(value), F.lit(n)).cast("int").alias("__block")).agg(F.collect_set(value).alias(name))
    blocks = F.broadcast(blocks) if n <= MAX_BROADCAST_BLOCKS else blocks
    return rows.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(blocks, "__block").drop("__block")


def exclude(editais: DataFrame, itens: DataFrame, regras: DataFrame) -> DataFrame:
    """(``usuario_id, edital_id``) that a tenant's rules (``usuario_id, tipo, valor``) exclude: a term inside the normalized text, or a category."""
    texts = itens.groupBy("edital_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("numero", normalize(F.col("descricao")).alias("t")))), lambda x: x["t"]), " ").alias("itens"))
    notices = editais.select(F.col("id").alias("edital_id"), normalize(F.col("objeto")).alias("objeto"), "modalidade").join(texts, "edital_id", "left")
    notices = notices.withColumn("alvo", F.concat_ws(" ", "objeto", F.coalesce("itens", F.lit(""))))
    terms = regras.filter("tipo = 'termo'").select("usuario_id", normalize(F.col("valor")).alias("termo")).filter("termo <> ''").distinct()
    kinds = regras.filter("tipo = 'categoria'").select("usuario_id", F.col("valor").alias("modalidade")).distinct()
    met = term_hits(notices.select("edital_id", "alvo"), terms, "edital_id", "alvo")
    by_term = met.join(terms, "termo").select("usuario_id", "edital_id")
    by_kind = notices.join(kinds, "modalidade").select("usuario_id", "edital_id")
    return by_term.unionByName(by_kind).distinct()


def matching_scope(editais: DataFrame, usuarios: DataFrame, matches: DataFrame, as_of: dt.date) -> DataFrame:
    """(``usuario_id, edital_id``) to match: notices still open for every tenant, and those that a tenant tracks."""
    still = editais.filter(F.col("data_encerramento").isNull() | (F.col("data_encerramento") >= F.lit(as_of))).select(F.col("id").alias("edital_id"))
    open_pairs = _with_blocks(still, usuarios.select("id").distinct(), "id", "ids").select(F.explode("ids").alias("usuario_id"), "edital_id")
    return open_pairs.unionByName(matches.filter(F.col("status").isin(TRACKED)).select(*MATCH_KEY)).distinct()


def scope_by_notice(editais: DataFrame, usuarios: DataFrame, matches: DataFrame, as_of: dt.date) -> DataFrame:
    """``matching_scope`` as ``edital_id, usuarios``, a row for each notice: tenants of open notices are one list, which no row is made from. With more tenants than are broadcast the pairs are gathered."""
    ids = usuarios.select("id").distinct()
    if ids.count() > BLOCK * MAX_BROADCAST_BLOCKS:
        return matching_scope(editais, usuarios, matches, as_of).groupBy("edital_id").agg(F.collect_set("usuario_id").alias("usuarios"))
    still = editais.filter(F.col("data_encerramento").isNull() | (F.col("data_encerramento") >= F.lit(as_of))).select(F.col("id").alias("edital_id")).distinct()
    every = still.crossJoin(F.broadcast(ids.agg(F.array_sort(F.collect_set("id")).alias("__all"))))
    followed = matches.filter(F.col("status").isin(TRACKED)).groupBy("edital_id").agg(F.collect_set("usuario_id").alias("__own"))
    both = every.join(followed, "edital_id", "full_outer")
    merged = F.when(F.col("__own").isNull(), F.col("__all")).when(F.col("__all").isNull(), F.col("__own")).otherwise(F.array_union("__all", "__own"))
    return both.select("edital_id", merged.alias("usuarios")).filter(F.size("usuarios") > 0)


def resume_from(df: DataFrame, at: dt.datetime | None, at_id: int | None, now: dt.datetime, max_age: dt.timedelta = dt.timedelta(hours=12), saved: dt.datetime | None = None) -> DataFrame:
    """Rows after a checkpoint in descending (``coletado_em, id``); a checkpoint that is too old counts for nothing."""
    if at is None or saved is None or now - saved > max_age:
        return df
    return df.filter(F.struct(F.col("coletado_em"), F.col("id")) < F.struct(F.lit(at).cast("timestamp").alias("coletado_em"), F.lit(at_id).cast("long").alias("id")))


def trusted(legacy: bool = False) -> Column:
    """High confidence or confirmed by hand; with ``legacy`` an entry from before confidences counts too."""
    ok = F.coalesce(F.col("confianca") == "alta", F.lit(False)) | F.coalesce(F.col("confirmado_manualmente"), F.lit(False))
    return ok | ~F.coalesce(F.col("confianca_presente"), F.lit(True)) if legacy else ok


def trusted_items(match_itens: DataFrame, legacy: bool = False) -> DataFrame:
    return match_itens.filter(trusted(legacy))


def engaged(matches: DataFrame, match_itens: DataFrame) -> DataFrame:
    """``matches`` with ``engajado``: touched by its tenant in any way."""
    confirmed = match_itens.filter("confirmado_manualmente").select(*MATCH_KEY).distinct().withColumn("__c", F.lit(True))
    return matches.join(confirmed, MATCH_KEY, "left").withColumn("engajado", (F.col("status") != "novo") | F.col("lido") | F.col("interessante") | F.coalesce("__c", F.lit(False))).drop("__c")


def target_tenants(matches: DataFrame, usuarios: DataFrame) -> DataFrame:
    return usuarios.filter("ativo").join(matches.select(F.col("usuario_id").alias("id")), "id", "left_semi")
