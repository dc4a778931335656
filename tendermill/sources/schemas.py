"""The tables of the tender data with fixed types, and loading that holds a source to them."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of each table; JSON columns are texts.
TABLES = {
    "usuarios": """id bigint not null, nome string not null, email string not null, senha_hash string not null, doc_cifrado string, endereco_cifrado string,
        dados_empresa_cifrado string, logo_base64 string, email_verificado boolean not null, token_verificacao string, token_reset_senha string,
        token_reset_expira timestamp, gemini_key_cifrada string, telegram_chat_id string, telegram_codigo string, telegram_chat_id_2 string,
        telegram_codigo_2 string, notif_email boolean not null, notif_telegram boolean not null, avisar_abertura boolean not null,
        dias_antecedencia int not null, ativo boolean not null, criado_em timestamp not null, recalculo_checkpoint_edital_id bigint,
        recalculo_checkpoint_coletado_em timestamp, recalculo_checkpoint_em timestamp, versao_catalogo int not null, versao_documentos int not null""",
    "fornecedores": """id bigint not null, usuario_id bigint, nome string not null, telefone string, whatsapp string, email string, site string, observacao string,
        ativo boolean not null, criado_em timestamp not null""",
    "produtos": """id bigint not null, usuario_id bigint, descricao string not null, ncm string, cest string, ean string, catmat string, catser string,
        palavras_chave string, fabricante string, marca string, modelo string, preco_custo double, preco_venda double, unidade_venda string,
        itens_por_unidade double, fornecedor_nome string, fornecedor_contato string, fornecedor_site string, fornecedor_id bigint, ativo boolean not null,
        criado_em timestamp not null""",
    "editais": """id bigint not null, fonte string not null, id_externo string not null, orgao string, cnpj_orgao string, objeto string, modalidade string, uf string,
        municipio string, valor_estimado double, data_publicacao date, data_abertura date, data_encerramento date, link string, raw string, analise_ia string,
        analise_em timestamp, coletado_em timestamp not null, itens_completados_em timestamp, itens_completados_qtd int not null""",
    "itens_edital": """id bigint not null, edital_id bigint not null, numero int, descricao string not null, material_ou_servico string, ncm string,
        catalogo_codigo string, quantidade double, valor_unitario double, unidade_medida string""",
    "matches": """id bigint not null, usuario_id bigint, edital_id bigint not null, score double not null, nivel string not null, itens_compativeis int not null,
        detalhe string, lido boolean not null, interessante boolean not null, notificado boolean not null, prazo_avisado boolean not null,
        prazo_avisado_telegram boolean not null, abertura_avisada boolean not null, abertura_avisada_telegram boolean not null, status string not null,
        criado_em timestamp not null, interagido_em timestamp""",
    "analise_ia_extras": """id bigint not null, usuario_id bigint not null, edital_id bigint not null, comparacao_catalogo_ia string, versao_catalogo_calc int,
        verificacao_documentos_ia string, versao_documentos_calc int, atualizado_em timestamp not null""",
    "regras_exclusao": "id bigint not null, usuario_id bigint, tipo string not null, valor string not null, ativo boolean not null",
    "logs_coleta": """id bigint not null, usuario_id bigint, fonte string not null, origem string, iniciado_em timestamp not null, finalizado_em timestamp,
        editais_novos int not null, editais_vistos int not null, matches_fortes int not null, erro string""",
    "configuracoes": "chave string not null, valor string not null",
    "documentos": """id bigint not null, usuario_id bigint, nome string not null, orgao_emissor string, data_validade date not null, link string, observacao string,
        ativo boolean not null, texto_extraido string, arquivo_cifrado string, arquivo_nome string, arquivo_tipo string, avisado_para date,
        avisado_para_telegram date, criado_em timestamp not null""",
    "propostas": """id bigint not null, usuario_id bigint, edital_id bigint not null, itens string, observacoes string, criado_em timestamp not null,
        atualizado_em timestamp not null""",
}

#: Types that a source may have in place of a column's own: what Spark widens without loss.
_WIDENS = {
    "bigint": {"int", "smallint", "tinyint"}, "int": {"smallint", "tinyint"}, "double": {"float", "int", "smallint", "tinyint"},
    "timestamp": {"timestamp_ntz", "date"}, "boolean": set(), "string": set(), "date": set(),
}


class SchemaError(ValueError):
    """A source that doesn't have the columns of its table; ``problems`` names each."""

    def __init__(self, table: str, problems: list[str]):
        super().__init__(f"{table}: {'; '.join(problems)}")
        self.problems = problems


@lru_cache
def schema_of(table: str) -> T.StructType:
    if table not in TABLES:
        raise KeyError(f"no table {table}; there are {', '.join(TABLES)}")
    return T.StructType.fromDDL(TABLES[table])


def _fits(have: T.DataType, want: T.DataType) -> bool:
    name = have.simpleString()
    text = name.startswith(("varchar", "char")) and want.simpleString() == "string"
    return text or name == want.simpleString() or name in _WIDENS[want.simpleString()] or (want.simpleString() == "double" and name.startswith("decimal"))


def typed(df: DataFrame, table: str) -> DataFrame:
    """``df`` with the columns and types of a table, in its order; names are compared without case.

    A column that may be null and is missing becomes nulls, and columns that the table doesn't have are left out. A missing column that
    must be there, and a type that can't be widened without loss, are a ``SchemaError`` that names all of them, before any row is read.
    """
    have = {f.name.lower(): f for f in df.schema.fields}
    problems, columns = [], []
    for f in schema_of(table).fields:
        own = have.get(f.name)
        if own is None and not f.nullable:
            problems.append(f"{f.name} is missing")
        elif own is not None and not _fits(own.dataType, f.dataType):
            problems.append(f"{f.name} is {own.dataType.simpleString()}, not {f.dataType.simpleString()}")
        else:
            value = F.lit(None) if own is None else F.col("`" + own.name.replace("`", "``") + "`")
            columns.append(value.cast(f.dataType).alias(f.name))
    if problems:
        raise SchemaError(table, problems)
    return df.select(*columns)


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table that lies as Parquet under ``root``, held to its schema; only footers are read for that, and scans stay prunable."""
    return typed(spark.read.parquet(f"{root.rstrip('/')}/{table}"), table)


def load_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, partitions: int = 16, column: str = "id") -> DataFrame:
    """The same table from a database, read in ranges of an integer column by as many tasks as ``partitions``.

    The bounds are asked for first; a table without the column, or without rows, is read by one task. Filters and columns go to the
    database with each range.
    """
    options = properties or {}
    if column not in schema_of(table).names:
        return typed(spark.read.jdbc(url, table, properties=options), table)
    low, high = spark.read.jdbc(url, f"(select min({column}) as lo, max({column}) as hi from {table}) b", properties=options).first()
    if low is None:
        return typed(spark.read.jdbc(url, table, properties=options), table)
    return typed(spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high + 1, numPartitions=partitions, properties=options), table)
