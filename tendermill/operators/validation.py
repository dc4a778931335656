"""Checks of a product's attributes against an item's demands, as joins and sums over attribute tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import FEATURES, extract_attributes, feature_state, staple_size
from ..functions.numbers import to_family
from ..functions.text import normalize_light


def correct_package(offers: DataFrame) -> DataFrame:
    """Sheets of a product (``itens_por_unidade`` beside its attributes) are those of the whole package where that has more; the chain is lost."""
    whole = (F.col("unidade") == "folhas") & (F.col("itens_por_unidade") > F.col("valor"))
    fixed = F.coalesce(whole, F.lit(False))
    return offers.withColumn("cadeia_id", F.when(~fixed, F.col("cadeia_id"))).withColumn("valor", F.when(fixed, F.col("itens_por_unidade")).otherwise(F.col("valor")))


def group_demands(demands: DataFrame) -> DataFrame:
    """Demands (``par`` and attributes) by family: those of a chain together, guessed fields together, loose ones together."""
    kind = F.when(F.col("cadeia_id").isNotNull(), "cadeia").when(F.col("inferido"), "campo").otherwise("solto")
    fam = to_family(demands).withColumn("grupo", kind).withColumn("cadeia", F.coalesce("cadeia_id", F.lit(-1)))
    first = F.min(F.struct("pos", "valor_canon", "operador", "inferido", "bruto"))
    return fam.groupBy("par", "familia", "grupo", "cadeia").agg(
        F.count("*").alias("n"), F.count_distinct("valor_canon").alias("valores"), F.sort_array(F.collect_list("valor_canon")).alias("exigidos"),
        F.max("inferido").alias("algum_inferido"), first.alias("p"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "bruto"))), lambda x: x["bruto"]), " x ").alias("texto_exigido"),
    )


def group_offers(offers: DataFrame) -> DataFrame:
    fam = to_family(correct_package(offers))
    return fam.groupBy("par", "familia").agg(
        F.count_distinct("valor_canon").alias("valores_oferta"), F.max("valor_canon").alias("maior"), F.sort_array(F.collect_list("valor_canon")).alias("ofertados"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "bruto"))), lambda x: x["bruto"]), ", ").alias("texto_ofertado"),
    )


def _meets(offered: Column, operator: Column, wanted: Column) -> Column:
    return F.when(operator == ">=", offered >= wanted).when(operator == "<=", offered <= wanted).otherwise(offered == wanted)


def check_numeric(demands: DataFrame, offers: DataFrame) -> DataFrame:
    """``par, tipo, descricao, critico`` of numeric demands that are not met for sure.

    Two or more values of a chain or of guessed fields are compared as a set; a single demand (or loose ones of one value)
    with the largest offer, unless the offers differ; loose demands that differ can't be judged. A guess never rejects.
    """
    both = group_demands(demands).join(group_offers(offers), ["par", "familia"], "left")
    as_set = (F.col("grupo") != "solto") & (F.col("n") >= 2)
    unclear = (F.col("grupo") == "solto") & (F.col("valores") > 1)
    none = F.col("ofertados").isNull()
    many = ~as_set & (F.col("valores_oferta") > 1)
    fails = F.when(as_set, F.col("exigidos") != F.col("ofertados")).otherwise(~_meets(F.col("maior"), F.col("p.operador"), F.col("p.valor_canon")))
    guess = F.when(as_set, F.col("algum_inferido")).otherwise(F.col("p.inferido"))
    verdict = F.when(unclear, "demanda_multipla").when(none, "sem_oferta").when(many, "oferta_multipla").when(fails & guess, "estimada").when(fails, "reprova")
    told = F.concat_ws(" ", F.lit("exige"), F.col("texto_exigido"), F.lit("/ oferece"), F.coalesce("texto_ofertado", F.lit("nada")))
    return both.withColumn("v", verdict).filter("v is not null").select("par", F.lit("numerico").alias("tipo"), F.concat_ws(": ", "v", told).alias("descricao"), (F.col("v") == "reprova").alias("critico"))


def check_categorical(pairs: DataFrame) -> DataFrame:
    """Of ``par, item_leve, produto_leve``: staple sizes that are missing (a warning) or differ (critical)."""
    both = pairs.withColumns({"a": staple_size(F.col("item_leve")), "b": staple_size(F.col("produto_leve"))}).filter("a is not null and not a <=> b")
    return both.select("par", F.lit("categorico").alias("tipo"), F.concat_ws(" ", F.lit("exige grampo"), "a", F.lit("/ oferece"), F.coalesce("b", F.lit("nada"))).alias("descricao"), F.col("b").isNotNull().alias("critico"))


def check_features(pairs: DataFrame) -> DataFrame:
    """Features that the item names: the opposite in the product is critical, silence a warning."""
    states = F.explode(F.array(*[F.struct(F.lit(f).alias("nome"), feature_state(F.col("item_leve"), f).alias("i"), feature_state(F.col("produto_leve"), f).alias("p")) for f in FEATURES]))
    rows = pairs.select("par", states.alias("s")).filter("s.i = 'presente' and s.p <> 'presente'")
    return rows.select("par", F.lit("caracteristica").alias("tipo"), F.concat_ws(": ", "s.nome", "s.p").alias("descricao"), (F.col("s.p") == "oposto").alias("critico"))


def verifiable(pairs: DataFrame, demands: DataFrame) -> DataFrame:
    """``par, verificavel``: the item has an attribute of any kind."""
    named = F.lit(False)
    for f in FEATURES:
        named = named | (feature_state(F.col("item_leve"), f) == "presente")
    has = demands.select("par").distinct().withColumn("__n", F.lit(True))
    return pairs.join(has, "par", "left").select("par", (F.coalesce("__n", F.lit(False)) | staple_size(F.col("item_leve")).isNotNull() | named).alias("verificavel"))


def classify(score: Column, critical: Column, warnings: Column, checkable: Column) -> Column:
    return F.when((score < 0.35) | (critical > 0), "Não atende").when((score >= 0.55) & (warnings == 0) & checkable, "Atende").otherwise("Atende parcialmente")


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """``par, pendencias, criticas, avisos, verificavel`` of pairs (``par, item_texto, produto_texto, itens_por_unidade``).

    Attributes are extracted once for each distinct text of either side, then joined to the pairs.
    """
    texts = pairs.select(F.col("item_texto").alias("texto")).unionByName(pairs.select(F.col("produto_texto").alias("texto")))
    attrs = extract_attributes(texts)
    demands = pairs.select("par", F.col("item_texto").alias("texto")).join(attrs, "texto")
    offers = pairs.select("par", "itens_por_unidade", F.col("produto_texto").alias("texto")).join(attrs, "texto")
    light = pairs.select("par", normalize_light(F.col("item_texto")).alias("item_leve"), normalize_light(F.col("produto_texto")).alias("produto_leve"))
    found = check_numeric(demands, offers).unionByName(check_categorical(light)).unionByName(check_features(light))
    sums = found.groupBy("par").agg(F.sort_array(F.collect_list(F.struct("tipo", "descricao", "critico"))).alias("pendencias"), F.count_if("critico").alias("criticas"), F.count_if(~F.col("critico")).alias("avisos"))
    out = verifiable(light, demands).join(sums, "par", "left")
    return out.withColumns({"criticas": F.coalesce("criticas", F.lit(0)), "avisos": F.coalesce("avisos", F.lit(0))})


def attach_validation(rows: DataFrame, itens: DataFrame, produtos: DataFrame, first_n: int | None = 4) -> DataFrame:
    """Match items with ``avaliacao, criticas, avisos, pendencias``: those with a product and a score, the first of each match in a listing; ``avaliacao`` is null where nothing can be checked."""
    key = ["usuario_id", "edital_id", "numero"]
    use = rows.filter("produto_id is not null and score_item is not null")
    if first_n:
        place = F.row_number().over(Window.partitionBy("usuario_id", "edital_id").orderBy(F.desc("score_item"), "numero"))
        use = use.withColumn("__n", place).filter(F.col("__n") <= first_n).drop("__n")
    both = use.join(itens.select("edital_id", "numero", F.col("descricao").alias("item_texto")), ["edital_id", "numero"]).join(
        produtos.select(F.col("id").alias("produto_id"), F.col("descricao").alias("produto_texto"), "itens_por_unidade"), "produto_id"
    )
    both = both.withColumn("par", F.xxhash64("item_texto", "produto_texto", "itens_por_unidade"))
    judged = validate_pairs(both.select("par", "item_texto", "produto_texto", "itens_por_unidade").dropDuplicates(["par"]))
    out = both.join(judged, "par")
    return out.select(*key, F.when(F.col("verificavel"), classify(F.col("score_item"), F.col("criticas"), F.col("avisos"), F.col("verificavel"))).alias("avaliacao"), "criticas", "avisos", "pendencias")
