"""Registered queries: sinks and table maintenance."""

from __future__ import annotations


import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters, tables
from ..runtime import scratch
from .views import AS_OF, Registry, Tables

R = Registry()
_D = "date '1998-08-01'"


@R.add("snk_01_insert_if_absent", "with b as (select * from editais where id % 2 = 0 union all select * from editais where id % 3 = 0), n as (select id, id_externo, row_number() over (partition by fonte, id_externo order by id) as k from b where id_externo not in (select id_externo from editais where id % 5 = 0)) select id, id_externo from n where k = 1 union all select id, id_externo from editais where id % 5 = 0")
def _(t: Tables):
    e = t.editais
    batch = e.filter("id % 2 = 0").unionByName(e.filter("id % 3 = 0"))
    return tables.insert_if_absent(e.filter("id % 5 = 0"), batch, ["id"]).select("id", "id_externo")


@R.add("snk_02_upsert_catalog", """with old as (select id, usuario_id, descricao, marca, preco_venda from produtos where id % 3 <> 0),
b as (select usuario_id, upper(descricao) as descricao, case when id % 2 = 0 then marca end as marca, preco_venda + 1 as preco_venda, id as linha from produtos where id % 4 = 0),
k as (select usuario_id, lower(trim(descricao)) as k, arg_max(descricao, linha) as d, arg_max(marca, case when marca is not null then linha end) as m, arg_max(preco_venda, linha) as p from b group by all),
o as (select *, lower(trim(descricao)) as k from old)
select o.id, coalesce(o.usuario_id, k.usuario_id) as usuario_id, coalesce(k.d, o.descricao) as descricao, coalesce(k.m, o.marca) as marca, coalesce(k.p, o.preco_venda) as preco_venda, case when o.k is null then 'criado' when k.k is null then 'igual' else 'atualizado' end as acao from o full outer join k on o.usuario_id = k.usuario_id and o.k = k.k""")
def _(t: Tables):
    p = t.produtos
    old = p.filter("id % 3 <> 0").select("id", "usuario_id", "descricao", "marca", "preco_venda")
    batch = p.filter("id % 4 = 0").select("usuario_id", F.upper("descricao").alias("descricao"), F.when(F.col("id") % 2 == 0, F.col("marca")).alias("marca"), (F.col("preco_venda") + 1).alias("preco_venda"), F.col("id").alias("linha"))
    return tables.upsert_catalog(old, batch, "linha", ["marca", "preco_venda"])


@R.add("snk_03_link_suppliers", "with f as (select usuario_id, max(id) as fid, regexp_replace(telefone, '\\D', '', 'g') as d from fornecedores group by usuario_id, d), b as (select id, usuario_id, case when id % 7 = 0 then '000' else telefone end as telefone from fornecedores) select b.id, fid as fornecedor_id, fid is null and regexp_replace(b.telefone, '\\D', '', 'g') <> '' as erro from b left join f on f.usuario_id = b.usuario_id and f.d = regexp_replace(b.telefone, '\\D', '', 'g')")
def _(t: Tables):
    batch = t.fornecedores.select("id", "usuario_id", F.when(F.col("id") % 7 == 0, "000").otherwise(F.col("telefone")).alias("telefone"))
    return tables.link_suppliers(batch, t.fornecedores).select("id", "fornecedor_id", "erro")


_GONE = "gone as (select usuario_id, id as produto_id from produtos where id % 6 = 0)"
_KEPT = f"{_GONE}, kept as (select m.* from match_itens m where not exists (select 1 from gone g where g.usuario_id = m.usuario_id and g.produto_id = m.produto_id))"


def _gone(t: Tables):
    return t.produtos.filter("id % 6 = 0").select("usuario_id", F.col("id").alias("produto_id"))


@R.add("snk_05_drop_references", f"with {_KEPT}, touched as (select distinct usuario_id, edital_id from match_itens m where exists (select 1 from gone g where g.usuario_id = m.usuario_id and g.produto_id = m.produto_id)), c as (select usuario_id, edital_id, count(*) as n from kept group by all) select m.usuario_id, m.edital_id, m.score, c.n as itens_compativeis from matches m left join c using (usuario_id, edital_id) where c.n is not null or not exists (select 1 from touched x where x.usuario_id = m.usuario_id and x.edital_id = m.edital_id)")
def _(t: Tables):
    matches, _items = tables.drop_product_references(t.matches, t.match_itens, _gone(t))
    return matches.select("usuario_id", "edital_id", "score", "itens_compativeis")


@R.add("snk_06_delete_products", f"with {_KEPT} select usuario_id, edital_id, numero, produto_id from kept")
def _(t: Tables):
    _matches, items = tables.drop_product_references(t.matches, t.match_itens, _gone(t))
    return items.select("usuario_id", "edital_id", "numero", "produto_id")


@R.add("snk_07_purge_logs", "select event_id from events where ts >= (select max(ts)::date from events) - interval 10 day")
def _(t: Tables):
    last = t.events.agg(F.to_date(F.max("ts"))).first()[0]
    return tables.purge_logs(t.events, "ts", last, days=10).select("event_id")


_USED = "used as (select edital_id from matches where nivel = 'forte' union select edital_id from matches where status = 'ganho'), gone as (select id from editais where data_abertura < date '1998-08-01' and id not in (select edital_id from used))"


def _pruned(t: Tables):
    m = t.matches
    return tables.prune_orphans(t.editais, t.itens, [m.filter("nivel = 'forte'"), m.filter("status = 'ganho'")], AS_OF)


@R.add("snk_08_prune_notices", f"with {_USED} select id from editais where id not in (select id from gone)")
def _(t: Tables):
    return _pruned(t)[0].select("id")


@R.add("snk_08_prune_items", f"with {_USED} select edital_id, numero from itens where edital_id not in (select id from gone)")
def _(t: Tables):
    return _pruned(t)[1].select("edital_id", "numero")


@R.add("snk_09_purge_weak", "select usuario_id, edital_id, nivel from matches where not (nivel = 'fraco' and usuario_id = 4)")
def _(t: Tables):
    return tables.purge_weak(t.matches, 4).select("usuario_id", "edital_id", "nivel")


_FOUND = "select edital_id, numero, case when numero % 3 = 0 then '' else 'CX ' || numero end as unidade_medida from itens where edital_id % 2 = 0"


@R.add("snk_11_backfill_unit", f"select i.edital_id, i.numero, coalesce(i.unidade_medida, nullif(f.unidade_medida, '')) as unidade_medida from itens i left join ({_FOUND}) f on f.edital_id = i.edital_id and f.numero = i.numero")
def _(t: Tables):
    i = t.itens
    found = i.filter("edital_id % 2 = 0").select("edital_id", "numero", F.when(F.col("numero") % 3 == 0, "").otherwise(F.concat(F.lit("CX "), "numero")).alias("unidade_medida"))
    return tables.backfill_unit(i, found).select("edital_id", "numero", "unidade_medida")


@R.add("snk_11_backfill_scope", f"select id from editais e where exists (select 1 from itens i where i.edital_id = e.id and i.unidade_medida is null) and (e.data_abertura is null or e.data_abertura >= {_D} or exists (select 1 from matches m where m.edital_id = e.id and m.status in ('proposta_enviada', 'ganho', 'perdido')))")
def _(t: Tables):
    return tables.backfill_scope(t.editais, t.itens, t.matches, AS_OF, filters.TRACKED).select("id")


@R.add("snk_12_apply_descriptions", "with c as (select edital_id, numero, case when numero % 4 = 0 then ' ' when numero % 4 = 1 then descricao else descricao || ' completa' end as d from itens where edital_id % 2 = 1) select i.edital_id, i.numero, coalesce(nullif(trim(c.d), ''), i.descricao) as descricao, (nullif(trim(c.d), '') is not null and trim(c.d) <> i.descricao) as mudou from itens i left join c on c.edital_id = i.edital_id and c.numero = i.numero")
def _(t: Tables):
    n = F.col("numero") % 4
    done = t.itens.filter("edital_id % 2 = 1").select("edital_id", "numero", F.when(n == 0, " ").when(n == 1, F.col("descricao")).otherwise(F.concat("descricao", F.lit(" completa"))).alias("descricao_completa"))
    return tables.apply_descriptions(t.itens, done).select("edital_id", "numero", "descricao", "mudou")


_EXPORT = """with c as (select usuario_id, edital_id, count(*) filter (score >= 0.5) as itens_compativeis from item_scores group by all)
select m.usuario_id, m.nivel, m.score, c.itens_compativeis, e.orgao, e.uf, 'Municipio ' || (e.id % 50) as municipio, e.modalidade, e.valor_estimado, e.data_encerramento, substr(e.objeto, 1, 300) as objeto, 'https://exemplo/' || e.id_externo as link
from matches m join editais e on e.id = m.edital_id join c on c.usuario_id = m.usuario_id and c.edital_id = m.edital_id"""


def _exported(t: Tables, nivel: str | None = None):
    counts = t.item_scores.groupBy("usuario_id", "edital_id").agg(F.count_if(F.col("score") >= 0.5).alias("itens_compativeis"))
    editais = t.editais.withColumns({"municipio": F.concat(F.lit("Municipio "), (F.col("id") % 50).cast("string")), "link": F.concat(F.lit("https://exemplo/"), "id_externo")})
    return tables.export_matches(t.matches.join(counts, ["usuario_id", "edital_id"]), editais, nivel)


@R.add("snk_13_export_matches", f"{_EXPORT} where m.nivel = 'forte'")
def _(t: Tables):
    return _exported(t, "forte")


_CATALOG = """select p.usuario_id, p.descricao, p.marca || ' ' || p.modelo as palavras_chave, cast(p.id % 97 as varchar(20)) as ncm, null::varchar as ean, cast(p.id % 53 as varchar(20)) as catmat, null::varchar as catser, null::varchar as fabricante, p.marca, p.modelo,
p.preco_custo, p.preco_venda, case when p.id % 2 = 0 then 'CX' end as unidade_venda, p.itens_por_unidade, coalesce(f.telefone, '') as fornecedor_telefone, f.nome as fornecedor_nome, null::varchar as fornecedor_contato, null::varchar as fornecedor_site
from produtos p left join fornecedores f on f.id = p.fornecedor_id"""


def _catalog(t: Tables):
    k = F.col("id")
    named = t.fornecedores.select(k.alias("fornecedor_id"), F.col("nome").alias("fornecedor_nome"))
    more = {"palavras_chave": F.concat_ws(" ", "marca", "modelo"), "ncm": (k % 97).cast("string"), "catmat": (k % 53).cast("string"), "unidade_venda": F.when(k % 2 == 0, "CX")}
    return tables.export_catalog(t.produtos.withColumns(more).join(named, "fornecedor_id", "left"), t.fornecedores)


@R.add("snk_14_export_catalog", _CATALOG)
def _(t: Tables):
    return _catalog(t)


@R.add("snk_14_catalog_file", _CATALOG)
def _(t: Tables):
    rows, path = _catalog(t), scratch(t.spark, "catalog")
    tables.write_csv(rows, path)
    back = t.spark.read.schema(rows.schema).option("sep", ";").option("header", True).option("escape", '"').csv(path)
    return back.fillna("", ["fornecedor_telefone"])


@R.add("snk_15_run_log", "select usuario_id, count(*) as vistos, count(*) filter (edital_id % 2 = 1) as novos, count(*) filter (edital_id % 2 = 1 and nivel = 'forte') as fortes from matches group by usuario_id")
def _(t: Tables):
    return tables.run_log(t.matches.withColumn("novo", F.col("edital_id") % 2 == 1), "usuario_id")


@R.add("snk_16_outbox", "select usuario_id, count(*) as n, string_agg(edital_id, ',' order by edital_id) as editais, 'novos' as tipo, 'email' as canal from matches where nivel = 'forte' and not lido group by usuario_id")
def _(t: Tables):
    return tables.outbox(t.matches.filter("nivel = 'forte' and not lido"), "novos", "email")


_CONF = "select usuario_id, edital_id, numero + (case when edital_id % 13 = 0 then 100 else 0 end) as numero, case when edital_id % 4 = 0 then null when edital_id % 4 = 1 then produto_ref + 1 else produto_ref end as produto_id from item_scores where confirmado and edital_id % 3 = 0"
_OK = f"c as ({_CONF}), ok as (select c.* from c join itens i on i.edital_id = c.edital_id and i.numero = c.numero left join produtos p on p.id = c.produto_id and p.usuario_id = c.usuario_id where c.produto_id is null or p.id is not null)"


def _confirmed(t: Tables):
    e = F.col("edital_id")
    c = t.item_scores.filter("confirmado and edital_id % 3 = 0").select(
        "usuario_id", "edital_id", (F.col("numero") + F.when(e % 13 == 0, 100).otherwise(0)).alias("numero"),
        F.when(e % 4 == 0, None).when(e % 4 == 1, F.col("produto_ref") + 1).otherwise(F.col("produto_ref")).alias("produto_id"),
    )
    return tables.confirm_items(t.matches.filter("edital_id % 2 = 0"), t.match_itens.filter("edital_id % 2 = 0"), c, t.itens, t.produtos)


@R.add("snk_17_confirm_items", f"with {_OK}, m as (select * from match_itens where edital_id % 2 = 0) select coalesce(m.usuario_id, ok.usuario_id) as usuario_id, coalesce(m.edital_id, ok.edital_id) as edital_id, coalesce(m.numero, ok.numero) as numero, case when ok.usuario_id is not null then ok.produto_id else m.produto_id end as produto_id, case when ok.usuario_id is not null then case when ok.produto_id is null then 0.0 else 1.0 end else m.score_item end as score_item, (ok.usuario_id is not null or m.confirmado_manualmente) as confirmado_manualmente from m full outer join ok on ok.usuario_id = m.usuario_id and ok.edital_id = m.edital_id and ok.numero = m.numero")
def _(t: Tables):
    return _confirmed(t)[1].drop("confianca")


@R.add("snk_17_rejects", f"with {_OK} select * from c where not exists (select 1 from ok where ok.usuario_id = c.usuario_id and ok.edital_id = c.edital_id and ok.numero = c.numero)")
def _(t: Tables):
    return _confirmed(t)[2]


@R.add("snk_18_apply_flags", """with c as (select user_id % 10 as usuario_id, 1 + event_id % 3000 as edital_id, event_id as em, case when event_type = 'view' then true end as lido, case when event_type = 'click' then true end as interessante, case when event_type = 'purchase' then 'ganho' when event_type = 'error' then 'xx' end as status from events),
k as (select usuario_id, edital_id, arg_max(lido, case when lido is not null then em end) as l, arg_max(interessante, case when interessante is not null then em end) as i, arg_max(status, case when status = 'ganho' then em end) as s from (select usuario_id, edital_id, em, lido, interessante, case when status = 'ganho' then status end as status from c) group by all)
select coalesce(m.usuario_id, k.usuario_id) as usuario_id, coalesce(m.edital_id, k.edital_id) as edital_id, coalesce(k.l, m.lido, false) as lido, coalesce(k.i, m.interessante, false) as interessante, coalesce(k.s, m.status, 'novo') as status from matches m full outer join k on k.usuario_id = m.usuario_id and k.edital_id = m.edital_id""")
def _(t: Tables):
    kind = F.col("event_type")
    c = t.events.select((F.col("user_id") % 10).alias("usuario_id"), (1 + F.col("event_id") % 3000).alias("edital_id"), F.col("event_id").alias("em"), F.when(kind == "view", True).alias("lido"), F.when(kind == "click", True).alias("interessante"), F.when(kind == "purchase", "ganho").when(kind == "error", "xx").alias("status"))
    return tables.apply_flags(t.matches, c).select("usuario_id", "edital_id", "lido", "interessante", "status")


@R.add("snk_19_stale_cache", "select m.usuario_id, m.edital_id, (case when edital_id % 5 = 0 then null else edital_id % 3 end) is not null and edital_id % 3 <> u.id % 3 as desatualizado, edital_id % 5 = 0 as calcular from matches m join usuarios u on u.id = m.usuario_id")
def _(t: Tables):
    cache = t.matches.select("usuario_id", "edital_id", F.when(F.col("edital_id") % 5 != 0, F.col("edital_id") % 3).alias("versao_calc"))
    versions = t.usuarios.select(F.col("id").alias("usuario_id"), (F.col("id") % 3).alias("versao"))
    return tables.stale_cache(cache, versions).select("usuario_id", "edital_id", "desatualizado", "calcular")


@R.add("snk_20_bump_versions", "select u.id as usuario_id, u.id % 3 + coalesce(n, 0) as versao from usuarios u left join (select user_id % 10 as uid, count(*) as n from events where event_type = 'click' group by uid) e on e.uid = u.id")
def _(t: Tables):
    versions = t.usuarios.select(F.col("id").alias("usuario_id"), (F.col("id") % 3).alias("versao"))
    return tables.bump_versions(versions, t.events.filter("event_type = 'click'").select((F.col("user_id") % 10).alias("usuario_id")))


_SUPPLIERS = "select id, usuario_id, case when id % 2 = 0 then '' else nome end as nome, case when id % 3 = 0 then null else nome end as contato, case when id % 5 = 0 then ' ' else nome end as site, telefone, '+55 ' || cast(id as varchar(20)) as whatsapp from fornecedores"


@R.add("snk_03_fill_suppliers", f"""with f as ({_SUPPLIERS}), b as (select id as linha, usuario_id, 'n' || id as nome, '' as contato, 's' || id as site, '55' || id as d from fornecedores),
p as (select usuario_id, d, max(id) as fid from (select usuario_id, id, regexp_replace(telefone, '\\D', '', 'g') as d from f union all select usuario_id, id, regexp_replace(whatsapp, '\\D', '', 'g') from f) group by usuario_id, d),
l as (select p.fid, arg_max(b.nome, b.linha) as nome, arg_max(b.site, b.linha) as site from b join p on p.usuario_id = b.usuario_id and p.d = b.d group by p.fid)
select f.id, coalesce(nullif(trim(f.nome), ''), l.nome) as nome, nullif(trim(f.contato), '') as contato, coalesce(nullif(trim(f.site), ''), l.site) as site from f left join l on l.fid = f.id""")
def _(t: Tables):
    f, k = t.fornecedores, F.col("id")
    own = f.select("id", "usuario_id", F.when(k % 2 == 0, "").otherwise(F.col("nome")).alias("nome"), F.when(k % 3 != 0, F.col("nome")).alias("contato"), F.when(k % 5 == 0, " ").otherwise(F.col("nome")).alias("site"), "telefone", F.concat(F.lit("+55 "), k.cast("string")).alias("whatsapp"))
    rows = f.select(k.alias("linha"), "usuario_id", F.concat(F.lit("n"), "id").alias("nome"), F.lit("").alias("contato"), F.concat(F.lit("s"), "id").alias("site"), F.concat(F.lit("55-"), "id").alias("telefone"))
    return tables.fill_suppliers(own, tables.link_suppliers(rows, own), "linha").select("id", "nome", "contato", "site")


@R.add("snk_12_stamp_completed", "select id, case when id % 3 = 0 then timestamp '1998-08-01 12:00:00' end as completado_em from editais")
def _(t: Tables):
    results = t.editais.select(F.col("id").alias("edital_id"), F.when(F.col("id") % 3 == 0, "ok").when(F.col("id") % 3 == 1, "erro").alias("status"))
    return tables.stamp_completed(t.editais, results, dt.datetime(1998, 8, 1, 12)).select("id", "completado_em")


@R.add("snk_13_csv_file", _EXPORT)
def _(t: Tables):
    rows, path = _exported(t), scratch(t.spark, "export")
    tables.write_csv(rows, path)
    return t.spark.read.schema(rows.schema).option("sep", ";").option("header", True).option("escape", '"').csv(path)


def _run_of_sources(t: Tables):
    b = t.matches.join(t.editais.select(F.col("id").alias("edital_id"), F.col("uf").alias("fonte")), "edital_id").filter("fonte <> 'NATION_3'").withColumn("novo", F.col("edital_id") % 2 == 1)
    errors = t.nation.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("fonte"), F.repeat("n_name", F.lit(90)).alias("erro"))
    return b, errors


_BY_SOURCE = "with b as (select e.uf as fonte, m.nivel, m.edital_id % 2 = 1 as novo from matches m join editais e on e.id = m.edital_id where e.uf <> 'NATION_3') select n_name as fonte, count(b.fonte) as vistos, count(*) filter (novo) as novos, count(*) filter (novo and nivel = 'forte') as fortes, case when n_nationkey % 3 = 0 then substr(repeat(n_name, 90), 1, 500) end as erro from nation left join b on b.fonte = n_name group by n_name, n_nationkey having count(b.fonte) > 0 or n_nationkey % 3 = 0"


@R.add("snk_15_run_log_by_source", _BY_SOURCE)
def _(t: Tables):
    return tables.run_log_by_source(*_run_of_sources(t))


@R.add("snk_15_observed_log", _BY_SOURCE)
def _(t: Tables):
    sources = [r["n_name"] for r in t.nation.select("n_name").collect()]
    run, errors = _run_of_sources(t)
    return tables.write_with_log(run, scratch(t.spark, "run-rows"), sources, errors)


@R.add("snk_19_store_cache", "select m.usuario_id, m.edital_id, case when edital_id % 4 = 0 then null else status end as valor, u.id % 3 as versao_calc from matches m left join usuarios u on u.id = m.usuario_id")
def _(t: Tables):
    found = t.matches.select("usuario_id", "edital_id", F.when(F.col("edital_id") % 4 == 0, " ").otherwise(F.col("status")).alias("valor"))
    return tables.store_cache(found, t.usuarios.select(F.col("id").alias("usuario_id"), (F.col("id") % 3).alias("versao")))


QUERIES, ORACLES = R.queries, R.oracles
