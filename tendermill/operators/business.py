"""Cost and margin, price statistics, proposals, quotations, dashboard counts."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import first_int, is_package_unit, unit_price
from ..runtime import written
from .filters import MATCH_KEY, trusted, view_active
from .validation import attach_validation

MONEY = "decimal(18,4)"


def _sum(value: Column) -> Column:
    """A sum of money that doesn't depend on the order of rows."""
    return F.sum(value.cast(MONEY)).cast("double")


def cost_margin(price: Column, cost: Column, per_unit: Column, unit: Column) -> Column:
    """``margem, margem_pct, custo_comparavel, alerta_unidade`` of a product's cost against an item's price.

    A label with the product's own package size, or a package label without a number, means that both are priced by package;
    otherwise the cost is divided. Different sizes, unproven packages and margins beyond 300 % raise the alert.
    """
    n = F.when(per_unit > 0, per_unit).otherwise(F.lit(1.0))
    size = first_int(unit)
    same = F.coalesce((n > 1) & (size == n), F.lit(False))
    unproven = F.coalesce((n > 1) & size.isNull() & is_package_unit(unit), F.lit(False))
    differs = F.coalesce((n > 1) & size.isNotNull() & ~same, F.lit(False))
    comparable = rounded(F.when(same | unproven, cost).otherwise(cost / n), 4)
    margin = rounded(price - comparable, 4)
    pct = F.when(price != 0, rounded(margin / F.when(price != 0, price) * 100, 1))
    known = price.isNotNull() & cost.isNotNull()
    alert = differs | unproven | F.coalesce((pct < -300) | (pct > 300), F.lit(False))
    return F.struct(
        F.when(known, margin).alias("margem"), F.when(known, pct).alias("margem_pct"), F.when(known, comparable).alias("custo_comparavel"),
        (known & alert).alias("alerta_unidade"),
    )


#: A group of more different values than this is spread over tasks for its median.
HOT_GROUP = 100_000


def group_median(values: DataFrame, group: list[str], value: str = "valor", hot: int = HOT_GROUP) -> DataFrame:
    """The exact median ``m`` and the count ``n`` of each group's values that are not null; a group without any has no row.

    Equal values are counted first, and the counts of a group are ordered in one task. A group of more than ``hot`` different values is
    spread over tasks by ranges (``_spread_median``). The median is the mean of the values in the two middle places.
    """
    rows = values.select(*group, F.col(value).cast("double").alias("__v"))
    # nulls leave what is written, as a filter before would take each value twice
    counts = written(rows.groupBy(*group, "__v").agg(F.count("*").alias("__c")), "median-counts").filter(F.col("__v").isNotNull())
    large = written(counts.groupBy(*group).agg(F.count("*").alias("__k")).filter(F.col("__k") > hot).drop("__k"), "median-hot")
    if large.isEmpty():
        return _plain_median(counts, group)
    is_large = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])
    part = lambda how: counts.alias("a").join(large.alias("b"), is_large, how)
    return _plain_median(part("left_anti"), group).unionByName(_spread_median(part("left_semi"), group))


def _plain_median(counts: DataFrame, group: list[str]) -> DataFrame:
    whole = Window.partitionBy(*group)
    upto = F.sum("__c").over(whole.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumns({"__upto": upto, "n": F.sum("__c").over(whole)})
    return _middle(placed.select(*group, "__v", "__upto", "n"), group)


def _middle(placed: DataFrame, group: list[str]) -> DataFrame:
    """The median from each value's last place ``__upto`` in its group of ``n``."""
    middle = [F.min(F.when(F.col("__upto") >= k, F.col("__v"))) for k in (F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)]
    return placed.groupBy(*group, "n").agg((0.5 * middle[0] + 0.5 * middle[1]).alias("m")).select(*group, "m", "n")


def _spread_median(counts: DataFrame, group: list[str]) -> DataFrame:
    """Counts are dealt out by ranges of group and value; a value's place follows from the counts before it in its range and in earlier ranges of its group."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(counts.repartitionByRange(parts, *group, "__v").withColumn("__part", F.spark_partition_id()), "median-ranges")
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "__part").agg(F.sum("__c").alias("__s"))
    sums = sums.withColumns({"__base": F.coalesce(F.sum("__s").over(before), F.lit(0)), "n": F.sum("__s").over(whole)}).drop("__s")
    inside = Window.partitionBy(*group, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*group, "__part"]])
    placed = ranged.withColumn("__inside", F.sum("__c").over(inside)).alias("a").join(sums.alias("b"), keyed)
    return _middle(placed.select(*[F.col(f"a.{c}").alias(c) for c in group], "__v", (F.col("__inside") + F.col("__base")).alias("__upto"), "n"), group)


def outlier_band(values: DataFrame, group: list[str], value: str = "valor", mult: float = 15, min_n: int = 5) -> DataFrame:
    """``lo`` and ``hi`` around each group's median; null where the group is too small."""
    g = group_median(values, group, value)
    ok = (F.col("n") >= min_n) & (F.col("m") > 0)
    return g.select(*group, F.when(ok, F.col("m") / mult).alias("lo"), F.when(ok, F.col("m") * mult).alias("hi"))


def in_band(value: Column) -> Column:
    return F.col("lo").isNull() | ((value >= F.col("lo")) & (value <= F.col("hi")))


def price_stats(match_itens: DataFrame, itens: DataFrame) -> DataFrame:
    """Market prices of each product from trusted items, by piece, without outliers. (The band holds the median, so no sample is emptied.)"""
    refs = match_itens.filter(trusted() & F.col("produto_id").isNotNull()).select("produto_id", "edital_id", "numero")
    return stats_of_prices(refs.join(itens.select("edital_id", "numero", unit_price(F.col("descricao"), F.col("valor_unitario")).alias("valor")), ["edital_id", "numero"]))


def stats_of_prices(prices: DataFrame) -> DataFrame:
    """``price_stats`` of (``produto_id, valor``)."""
    values = written(prices.select("produto_id", "valor"), "prices").filter("valor is not null")
    kept = values.join(outlier_band(values, ["produto_id"]), "produto_id").filter(in_band(F.col("valor")))
    totals = kept.groupBy("produto_id").agg(F.count("*").alias("ocorrencias"), F.min("valor").alias("__lo"), _sum(F.col("valor")).alias("__s"), F.max("valor").alias("__hi"))
    return totals.join(group_median(kept, ["produto_id"]).select("produto_id", "m"), "produto_id").select(
        "produto_id", "ocorrencias", rounded("__lo", 2).alias("minimo"), rounded("m", 2).alias("mediana"),
        rounded(F.col("__s") / F.col("ocorrencias"), 2).alias("media"), rounded("__hi", 2).alias("maximo"),
    )


def price_evidence(match_itens: DataFrame, itens: DataFrame, editais: DataFrame) -> DataFrame:
    """The items behind each product's prices, with the reason why one doesn't count. The band is over all items of the product's notices."""
    refs = written(match_itens.filter(trusted() & F.col("produto_id").isNotNull()).select("produto_id", "edital_id", "numero"), "price-refs")
    priced = written(itens.select("edital_id", "numero", "valor_unitario", unit_price(F.col("descricao"), F.col("valor_unitario")).alias("valor")), "priced")
    around = refs.select("produto_id", "edital_id").distinct().join(priced.filter("valor is not null").select("edital_id", "valor"), "edital_id")
    return _evidence(refs.join(priced, ["edital_id", "numero"]), around, editais)


def evidence_of_items(itens: DataFrame, editais: DataFrame) -> DataFrame:
    """``price_evidence`` where each item is trusted for one product at most, its own ``produto_id`` (else null), so that no item is joined with another.

    An item takes along the products of its notice, for whose bands its price counts.
    """
    price = unit_price(F.col("descricao"), F.col("valor_unitario"))
    items = itens.filter("edital_id is not null").select("edital_id", "numero", "valor_unitario", price.alias("valor"), "produto_id", F.collect_set("produto_id").over(Window.partitionBy("edital_id")).alias("__all"))
    items = written(items.filter(F.size("__all") > 0), "priced")
    around = items.filter("valor is not null").select(F.explode("__all").alias("produto_id"), "valor")
    return _evidence(items.filter("produto_id is not null").drop("__all"), around, editais)


def _evidence(rows: DataFrame, around: DataFrame, editais: DataFrame) -> DataFrame:
    rows = rows.join(outlier_band(around, ["produto_id"]), "produto_id").join(editais.select(F.col("id").alias("edital_id"), "orgao", "uf"), "edital_id")
    reason = F.when(F.col("valor").isNull(), "sem_valor").when(~in_band(F.col("valor")), "fora_do_padrao")
    return rows.select(
        "produto_id", "edital_id", "numero", "orgao", "uf", rounded("valor", 4).alias("valor"),
        F.when(~F.col("valor").eqNullSafe(F.col("valor_unitario")), rounded("valor_unitario", 4)).alias("valor_original"),
        reason.isNull().alias("usado"), reason.alias("motivo"),
    )


def proposal_totals(rows: DataFrame) -> DataFrame:
    """Totals of each proposal from its lines (``MATCH_KEY, quantidade, preco_venda, preco_custo``)."""
    g = rows.groupBy(*MATCH_KEY).agg(_sum(F.col("quantidade") * F.col("preco_venda")).alias("total_venda"), _sum(F.col("quantidade") * F.col("preco_custo")).alias("total_custo"))
    margin = F.col("total_venda") - F.col("total_custo")
    return g.select(*MATCH_KEY, rounded("total_venda", 2).alias("total_venda"), rounded("total_custo", 2).alias("total_custo"), rounded(margin, 2).alias("margem"), F.when(F.col("total_venda") > 0, rounded(margin / F.col("total_venda") * 100, 1)).otherwise(F.lit(0.0)).alias("margem_pct"))


def quotation(match_itens: DataFrame, itens: DataFrame, produtos: DataFrame, freight: Column) -> DataFrame:
    """Quotation rows of trusted items; ``freight`` (over their columns) is in and out together for a line and is spread over its quantity."""
    rows = match_itens.filter(trusted() & F.col("produto_id").isNotNull()).select(*MATCH_KEY, "numero", "produto_id")
    rows = rows.join(itens.select("edital_id", "numero", "quantidade", "valor_unitario"), ["edital_id", "numero"]).join(produtos.select(F.col("id").alias("produto_id"), "preco_custo", "preco_venda", "itens_por_unidade"), "produto_id")
    unit = F.when(F.col("quantidade") > 0, freight / F.col("quantidade")).otherwise(F.lit(0.0))
    rows = rows.withColumn("frete_unitario", rounded(unit, 4)).withColumn("custo_total_unitario", rounded(F.col("preco_custo") + unit, 4))
    return rows.withColumn("total", rounded(F.col("custo_total_unitario") * F.col("quantidade"), 2))


def selected_quotation(
    match_itens: DataFrame, itens: DataFrame, produtos: DataFrame, fretes: DataFrame, selecao: DataFrame | None = None, matches: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Quotation rows of trusted items, of ``selecao`` (``ITEM_KEY``) alone if it is given, with freight in and out of each line.

    ``fretes`` has ``ITEM_KEY, frete_entrada, frete_saida``; what is missing costs nothing. The second table has an ``erro`` for every
    match of ``matches`` for which nothing is left to quote.
    """
    key = [*MATCH_KEY, "numero"]
    mine = match_itens if selecao is None else match_itens.join(selecao.select(*key).distinct(), key, "left_semi")
    freight = F.coalesce("frete_entrada", F.lit(0.0)) + F.coalesce("frete_saida", F.lit(0.0))
    rows = quotation(mine, itens, produtos, F.lit(0.0)).drop("frete_unitario", "custo_total_unitario", "total").join(fretes.select(*key, "frete_entrada", "frete_saida"), key, "left")
    unit = F.when(F.col("quantidade") > 0, freight / F.col("quantidade")).otherwise(F.lit(0.0))
    rows = rows.withColumn("frete_unitario", rounded(unit, 4)).withColumn("custo_total_unitario", rounded(F.col("preco_custo") + unit, 4))
    rows = rows.withColumn("total", rounded(F.col("custo_total_unitario") * F.col("quantidade"), 2))
    empty = None if matches is None else matches.select(*MATCH_KEY).join(rows.select(*MATCH_KEY), MATCH_KEY, "left_anti").withColumn("erro", F.lit("nenhum item"))
    return rows, empty


def proposal_lines(saved: DataFrame, match_itens: DataFrame, itens: DataFrame) -> DataFrame:
    """Lines of proposals (``MATCH_KEY, numero, descricao, quantidade, produto_id``): saved ones with the description that the item has now,
    and for matches without a saved proposal a skeleton of their trusted items. ``salva`` tells which.
    """
    now = itens.select("edital_id", "numero", F.col("descricao").alias("__d"))
    kept = saved.join(now, ["edital_id", "numero"], "left").withColumn("descricao", F.coalesce("__d", "descricao")).withColumn("salva", F.lit(True))
    fresh = match_itens.filter(trusted() & F.col("produto_id").isNotNull()).join(saved.select(*MATCH_KEY).distinct(), MATCH_KEY, "left_anti")
    fresh = fresh.select(*MATCH_KEY, "numero", "produto_id").join(itens.select("edital_id", "numero", "descricao", "quantidade"), ["edital_id", "numero"]).withColumn("salva", F.lit(False))
    columns = [*MATCH_KEY, "numero", "descricao", "quantidade", "produto_id", "salva"]
    return kept.select(columns).unionByName(fresh.select(columns))


def live_candidates(items: DataFrame, produtos: DataFrame) -> DataFrame:
    """``candidatos`` of items (``ITEM_KEY, candidatos``) with what their products are now; products that are gone are left out."""
    p = produtos.select("usuario_id", F.col("id").alias("produto_id"), F.col("descricao").alias("produto"), "preco_custo")
    each = items.select(*MATCH_KEY, "numero", F.explode("candidatos").alias("c")).select(*MATCH_KEY, "numero", "c.posicao", "c.produto_id", "c.score")
    live = each.join(p, ["usuario_id", "produto_id"])
    return live.groupBy(*MATCH_KEY, "numero").agg(F.sort_array(F.collect_list(F.struct("posicao", "produto_id", "score", "produto", "preco_custo"))).alias("candidatos"))


def with_live_products(itens: DataFrame, produtos: DataFrame, ref: str) -> DataFrame:
    """``itens`` with ``vivos``: what the products under ``ref`` are now, by tenant."""
    fact = F.struct("usuario_id", F.col("id").alias("produto_id"), F.col("descricao").alias("produto"), "preco_custo")
    return itens.join(produtos.groupBy(F.col("id").alias(ref)).agg(F.sort_array(F.collect_list(fact)).alias("vivos")), ref, "left").withColumn("vivos", F.coalesce("vivos", F.array()))


def live_of_lists(items: DataFrame) -> DataFrame:
    """``live_candidates`` of items that have the products of their notice in ``vivos`` (``usuario_id, produto_id, produto, preco_custo``)."""

    def facts(c):
        mine = F.array_distinct(F.filter("vivos", lambda v: (v["produto_id"] == c["produto_id"]) & (v["usuario_id"] == F.col("usuario_id"))))
        return F.transform(mine, lambda v: F.struct(c["posicao"].alias("posicao"), c["produto_id"].alias("produto_id"), c["score"].alias("score"), v["produto"].alias("produto"), v["preco_custo"].alias("preco_custo")))

    return items.select(*MATCH_KEY, "numero", F.flatten(F.transform("candidatos", facts)).alias("candidatos")).filter(F.size("candidatos") > 0)


def notice_detail(match_itens: DataFrame, itens: DataFrame, produtos: DataFrame, matches: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Each item of matched notices with its compatible product and margin; compatible ones first. Columns of ``judged`` (of ``ITEM_KEY``) come last.

    What is known of a compatible item is put together before the notices' items are joined with it, once: most of these have no
    product, and would all meet in one task if they were joined by it.
    """
    key = [*MATCH_KEY, "numero"]
    scope = matches.select(*MATCH_KEY).join(itens, "edital_id")
    mine = match_itens.filter(trusted()).select(*key, "produto_id", "score_item", "confianca", "confirmado_manualmente")
    p = produtos.select(F.col("id").alias("produto_id"), F.col("descricao").alias("produto"), "preco_custo", "itens_por_unidade")
    mine, more = mine.join(p, "produto_id", "left"), []
    if judged is not None:
        mine, more = mine.join(judged, key, "left"), [c for c in judged.columns if c not in key]
    rows = scope.join(mine, key, "left").withColumn("m", cost_margin(F.col("valor_unitario"), F.col("preco_custo"), F.col("itens_por_unidade"), F.col("unidade_medida")))
    return rows.select(*key, F.col("produto_id").isNotNull().alias("compativel"), "produto_id", "produto", "score_item", "confianca", "m.margem", "m.margem_pct", "m.custo_comparavel", "m.alerta_unidade", *more)


def validated_detail(match_itens: DataFrame, itens: DataFrame, produtos: DataFrame, matches: DataFrame) -> DataFrame:
    """``notice_detail`` with the technical validation of every compatible item that has a score.

    ``avaliacao`` is null for items without a compatible product, without a score, or without anything that could be checked; then
    ``pendencias`` is null too. Texts are scanned once each, whatever items and tenants have them.
    """
    judged = attach_validation(match_itens.filter(trusted()), itens, produtos, None).filter("avaliacao is not null")
    return notice_detail(match_itens, itens, produtos, matches, judged)


def summary(matches: DataFrame, editais: DataFrame, produtos: DataFrame, as_of: dt.date) -> DataFrame:
    """Dashboard of each tenant over its active matches."""
    e = editais.select(F.col("id").alias("edital_id"), "data_abertura", "valor_estimado")
    live = view_active(matches.join(e, "edital_id"), as_of)
    today = F.col("data_abertura") == F.lit(as_of)
    g = live.groupBy("usuario_id").agg(
        F.count("*").alias("ativos"), *[F.count_if(F.col("nivel") == n).alias(n) for n in ("forte", "medio", "fraco")], F.count_if(~F.col("lido")).alias("nao_lidos"),
        F.count_if(today).alias("abrem_hoje"), rounded(F.coalesce(_sum(F.when(today, F.col("valor_estimado"))), F.lit(0.0)), 2).alias("valor_hoje"),
    )
    n = produtos.groupBy("usuario_id").agg(F.count("*").alias("produtos"))
    return n.join(g, "usuario_id", "left").fillna(0)


def trusted_count(match_itens: DataFrame) -> DataFrame:
    return match_itens.groupBy(*MATCH_KEY).agg(F.count_if(trusted()).alias("n"))


def page_info(df: DataFrame, per_page: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("paginas", F.ceil(F.col("total") / per_page).cast("long"))


def run_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("acao").agg(F.count("*").alias("n"), F.count_if("novo_forte").alias("novos_fortes"))


def grouped_text(itens: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("numero", "descricao")))
    return itens.groupBy("edital_id").agg(F.array_join(F.transform(ordered, lambda x: x["descricao"]), " ").alias("texto"))
