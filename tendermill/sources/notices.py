"""Landed API pages, catalog files and model responses as tables. JSON is read as VARIANT, so odd shapes cost no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_br_number, parse_date

# Names of procurement modes by code.
MODES = {
    1: "Leilão Eletrônico", 2: "Diálogo Competitivo", 3: "Concurso", 4: "Concorrência Eletrônica", 5: "Concorrência Presencial",
    6: "Pregão Eletrônico", 7: "Pregão Presencial", 8: "Dispensa", 9: "Inexigibilidade", 10: "Manifestação de Interesse",
    11: "Pré-qualificação", 12: "Credenciamento", 13: "Leilão Presencial",
}
# Headers of catalog sheets.
HEADERS = {
    "descricao": ["descricao", "descrição", "produto", "nome"], "marca": ["marca", "fabricante"], "ncm": ["ncm"], "ean": ["ean", "codigo de barras"],
    "catmat": ["catmat"], "catser": ["catser"], "palavras_chave": ["palavras_chave", "palavras chave", "keywords"], "preco_custo": ["preco_custo", "custo"],
    "preco_venda": ["preco_venda", "venda", "preco"], "itens_por_unidade": ["itens_por_unidade", "itens por unidade"],
}
# Keys under which a catalog search lists its hits, and the aliases of a hit's fields.
LIST_KEYS = ["resultado", "resultados", "data", "items", "itens", "content", "materiais", "servicos"]
HIT_FIELDS = {
    "codigo": ["codigoItem", "codigoServico", "codigo", "codigoItemMaterial", "codigoItemServico", "id"],
    "descricao": ["descricaoItem", "descricao", "nomeItem", "descricaoItemMaterial", "descricaoItemServico", "descricaoServicoAcentuado", "nomeServicoAcentuado"],
    "pdm": ["nomePdm", "pdm"], "codigo_pdm": ["codigoPdm", "codigoPDM"], "classe": ["nomeClasse", "classe"], "grupo": ["nomeGrupo", "grupo"],
    "unidade": ["nomeUnidadeFornecimento", "unidadeFornecimento"], "ativo": ["statusItem", "status"],
}


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def first_of(v: Column, *paths: str) -> Column:
    """The first value that is there and not empty, as a string."""
    return F.coalesce(*[F.nullif(get(v, p), F.lit("")) for p in paths])


def variants(text: Column) -> Column:
    return F.try_parse_json(text)


def elements(df: DataFrame, v: Column, *keys: str, out: str = "e") -> DataFrame:
    """A row for each element of a VARIANT that is a list, or an object with the list under one of ``keys``."""
    own = F.try_variant_get(v, "$", "array<variant>")
    under = [F.try_variant_get(v, f"$.{k}", "array<variant>") for k in keys]
    return df.withColumn(out, F.explode(F.coalesce(own, *under)))


def read_notices(spark: SparkSession, path: str, modalidades: list[int] | None = None, ufs: list[str] | None = None) -> DataFrame:
    """Notice records (``v``) of landed pages, files of JSON with their records under ``data``. Files lie by mode and state if the filters are to prune."""
    pages = spark.read.text(path, wholetext=True).select(variants(F.col("value")).alias("pagina"))
    rows = elements(pages, F.col("pagina"), "data", out="v").select("v")
    if modalidades:
        rows = rows.filter(get(F.col("v"), "modalidadeId", "int").isin(modalidades))
    return rows.filter(get(F.col("v"), "unidadeOrgao.ufSigla").isin(ufs)) if ufs else rows


def notice_link(cnpj: Column, year: Column, seq: Column, fallback: Column, base: str = "https://pncp.gov.br/app/editais") -> Column:
    full = (F.coalesce(cnpj, F.lit("")) != "") & (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(seq, F.lit(0)) != 0)
    return F.when(full, F.concat_ws("/", F.lit(base), cnpj, year.cast("string"), seq.cast("string"))).otherwise(fallback)


def map_notices(raw: DataFrame, v: str = "v") -> DataFrame:
    """Notices from records; records without a control number are left out."""
    r = F.col(v)
    modes = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])
    mode = F.coalesce(F.nullif(get(r, "modalidadeNome"), F.lit("")), F.try_element_at(modes, get(r, "modalidadeId", "int")))
    return raw.select(
        F.lit("pncp").alias("fonte"), F.nullif(get(r, "numeroControlePNCP"), F.lit("")).alias("id_externo"),
        first_of(r, "orgaoEntidade.razaoSocial", "unidadeOrgao.nomeUnidade").alias("orgao"), get(r, "orgaoEntidade.cnpj").alias("cnpj_orgao"),
        get(r, "objetoCompra").alias("objeto"), mode.alias("modalidade"), get(r, "unidadeOrgao.ufSigla").alias("uf"), get(r, "unidadeOrgao.municipioNome").alias("municipio"),
        get(r, "valorTotalEstimado", "double").alias("valor_estimado"), parse_date(get(r, "dataAberturaProposta")).alias("data_abertura"),
        parse_date(get(r, "dataEncerramentoProposta")).alias("data_encerramento"),
        notice_link(get(r, "orgaoEntidade.cnpj"), get(r, "anoCompra", "int"), get(r, "sequencialCompra", "int"), get(r, "linkSistemaOrigem")).alias("link"),
        F.coalesce(first_of(r, "codigoCategoriaProcesso", "categoriaProcesso"), F.lit("")).alias("categoria_pncp"),
    ).filter("id_externo is not null")


def explode_items(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """Items of payloads (JSON text), which are a list or have it under ``data``."""
    rows = elements(raw.select(key, variants(F.col(payload)).alias("p")), F.col("p"), "data")
    e = F.col("e")
    return rows.select(
        key, get(e, "numeroItem", "int").alias("numero"), F.coalesce(get(e, "descricao"), F.lit("")).alias("descricao"),
        first_of(e, "materialOuServicoNome", "materialOuServico").alias("material_ou_servico"), get(e, "ncmNbsCodigo").alias("ncm"),
        F.coalesce(first_of(e, "codigoItemCatalogo", "catalogoCodigoItem"), F.lit("")).alias("catalogo_codigo"), get(e, "quantidade", "double").alias("quantidade"),
        get(e, "valorUnitarioEstimado", "double").alias("valor_unitario"), get(e, "unidadeMedida").alias("unidade_medida"),
    )


def map_transparencia(raw: DataFrame, v: str = "v") -> DataFrame:
    """Notices of the second source, each with one item from its object. A value is taken by its JSON type: numbers as they are, text as Brazilian."""
    r = F.col(v)
    ident = first_of(r, "id", "licitacao.numero", "numero")
    kind = F.schema_of_variant(F.try_variant_get(r, "$.valor", "variant"))
    number = F.when(kind == "STRING", F.try_to_number(F.replace(F.replace(get(r, "valor"), F.lit("."), F.lit("")), F.lit(","), F.lit(".")), F.lit("999999999999D99")).cast("double")).otherwise(get(r, "valor", "double"))
    objeto = F.coalesce(first_of(r, "objeto", "licitacao.objeto"), F.lit(""))
    return raw.select(
        F.lit("transparencia").alias("fonte"), F.concat(F.lit("transp-"), ident).alias("id_externo"), first_of(r, "unidadeGestora.orgaoVinculado.nome", "orgao.nome", "nomeOrgao").alias("orgao"),
        objeto.alias("objeto"), F.coalesce(first_of(r, "modalidadeLicitacao", "modalidade"), F.lit("")).alias("modalidade"), number.alias("valor_estimado"),
        parse_date(F.substring(get(r, "dataAbertura"), 1, 10), ("dd/MM/yyyy", "yyyy-MM-dd")).alias("data_abertura"),
        F.when(objeto != "", F.array(F.struct(F.lit(1).alias("numero"), F.substring(objeto, 1, 300).alias("descricao")))).alias("itens"),
    ).filter("id_externo is not null")


def read_catalog_csv(spark: SparkSession, path: str, usuario_id: int) -> DataFrame:
    """A tenant's catalog file: trimmed, blanks as nulls, rows without a description left out."""
    raw = spark.read.option("encoding", "UTF-8").csv(path, sep=";", header=True)
    clean = raw.select(*[F.nullif(F.trim(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿").strip()) for c in raw.columns])
    return clean.filter("descricao is not null").withColumn("usuario_id", F.lit(usuario_id).cast("long"))


def normalize_catalog_sheet(df: DataFrame, aliases: dict[str, list[str]] = HEADERS) -> tuple[DataFrame, DataFrame]:
    """Catalog rows under their usual names, and one row with the count of rows ignored for want of a description."""
    by_alias = {a: name for name, all_aliases in aliases.items() for a in all_aliases}
    found = {by_alias[c.strip().lower()]: c for c in reversed(df.columns) if c.strip().lower() in by_alias}
    if "descricao" not in found:
        raise ValueError("the sheet has no description column")
    rows = df.select(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")).alias(n) for n, c in found.items()])
    for n in ("preco_custo", "preco_venda", "itens_por_unidade"):
        if n in found:
            rows = rows.withColumn(n, parse_br_number(F.col(n)))
    return rows.filter("descricao is not null"), rows.agg(F.count_if(F.col("descricao").isNull()).alias("ignorados"))


def explode_attachments(raw: DataFrame, key: str, payload: str, base_url: str) -> DataFrame:
    """``titulo, tipo, url`` of attachments; a URL is rebuilt from the sequence if none is given."""
    rows = elements(raw.select(key, variants(F.col(payload)).alias("p")), F.col("p"), "data")
    e = F.col("e")
    url = F.coalesce(first_of(e, "url", "uri", "link", "linkArquivo"), F.concat(F.lit(base_url), F.lit("/"), get(e, "sequencialDocumento")))
    return rows.select(key, first_of(e, "titulo", "nomeArquivo", "nome").alias("titulo"), first_of(e, "tipoDocumentoNome").alias("tipo"), url.alias("url")).filter("url is not null")


def map_catalog_hits(raw: DataFrame, key: str, payload: str, tipo: str) -> DataFrame:
    """Hits of catalog searches under their usual names."""
    rows = elements(raw.select(key, variants(F.col(payload)).alias("p")), F.col("p"), *LIST_KEYS, "_embedded.itens")
    out = {n: first_of(F.col("e"), *paths) for n, paths in HIT_FIELDS.items()}
    out["descricao"] = F.coalesce(out["descricao"], F.lit(""))
    out["ativo"] = F.coalesce(out["ativo"].try_cast("boolean"), F.lit(True))
    return rows.select(key, F.lit(tipo).alias("tipo"), *[c.alias(n) for n, c in out.items()])


def control_number_parts(number: Column, cnpj: Column | None = None) -> Column:
    """``cnpj, ano, seq`` of ``cnpj-kind-seq/year``; null if it has another form. An explicit CNPJ wins."""
    pattern = r"^(\d+)-\d+-(\d+)/(\d{4})$"
    own = F.nullif(F.regexp_extract(number, pattern, 1), F.lit(""))
    parts = F.struct((F.coalesce(cnpj, own) if cnpj is not None else own).alias("cnpj"), F.regexp_extract(number, pattern, 3).try_cast("int").alias("ano"), F.regexp_extract(number, pattern, 2).try_cast("int").alias("seq"))
    return F.when(own.isNotNull(), parts)


def route_file(content: Column) -> Column:
    """The kind of a file by its first bytes: ole2, zip, else pdf."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == "D0CF11E0A1B11AE1", "ole2").when(F.startswith(head, F.lit("504B0304")), "zip").otherwise("pdf")


def attachment_rank(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(F.contains(low, F.lit("edital")), 0).when(F.contains(low, F.lit("termo")) | F.contains(low, F.lit("anexo")), 1).otherwise(2)


def combine_texts(texts: DataFrame, key: str, order: str, text: str, at_least: int = 300, most: int | None = 2, cap: int = 80_000, budget: int | None = None) -> DataFrame:
    """The first texts long enough, joined and cut to ``cap``; ``sem_texto`` where too little is left.

    ``most`` texts, or with a ``budget`` all texts that begin before so many characters are reached; ``order`` names a text within its key.
    What is taken is decided by lengths alone, and no key has more candidates than the budget can hold; only then texts are joined.
    """
    from pyspark.sql import Window

    inner = Window.partitionBy(key).orderBy(order)
    limit = min(n for n in (most, None if budget is None else budget // at_least + 1) if n is not None)
    first = texts.filter(F.length(text) > at_least).select(key, order, F.length(text).alias("__l")).withColumn("__n", F.row_number().over(inner)).filter(F.col("__n") <= limit)
    if budget is not None:
        first = first.withColumn("__s", F.sum("__l").over(inner)).filter(F.col("__s") - F.col("__l") < budget)
    rows = first.select(key, order, "__n").join(texts.select(key, order, F.col(text).alias("__t")), [key, order])
    joined = rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__t"))), lambda x: x["__t"]), "\n\n").alias("texto"))
    out = texts.select(key).distinct().join(joined, key, "left").withColumn("texto", F.substring(F.coalesce("texto", F.lit("")), 1, cap))
    return out.withColumn("sem_texto", F.length("texto") < at_least)


def _zip_kinds(batches):
    import io
    import zipfile

    for batch in batches:
        kinds = []
        for data in batch["content"]:
            try:
                kinds.append("docx" if "word/document.xml" in zipfile.ZipFile(io.BytesIO(data)).namelist() else "zip")
            except zipfile.BadZipFile:
                kinds.append("zip")
        yield batch.assign(rota=kinds)


def route_files(files: DataFrame) -> DataFrame:
    """``files`` (with ``content``) with ``rota``: ole2, docx, zip, else pdf. Only zips are opened, for their list of names."""
    routed = files.withColumn("rota", route_file(F.col("content")))
    zips = routed.filter("rota = 'zip'").mapInPandas(_zip_kinds, routed.schema)
    return routed.filter("rota is distinct from 'zip'").unionByName(zips)


def parse_response(text: Column) -> Column:
    """The JSON of a model's answer: as it is, or what lies between its first and last brace. What begins like no JSON is not tried as a whole, as each failure is dear."""
    whole = F.when(~F.rlike(text, F.lit(r"^\s*(?:`|[A-Za-z&&[^tfnNI]])")), F.try_parse_json(text))
    return F.coalesce(whole, F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def union_sources(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
