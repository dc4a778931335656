"""The registered queries of this subpackage, with their production parameters and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, jaccard_join, line_dedup, merkle, mixing, quality_classifier, quality_rules, sentence_pieces, sharding, substring_dedup, token_output, url_filters
from .common import fresh_path

# ---------------------------------------------------------------- parameters

MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {("web",): 5, ("forum",): 2, ("reference",): 3, ("web", "en"): 4, ("forum", "en"): 3, ("reference", "en"): 3, ("web", "en", "src0"): 2}
MIX_PCT, MIX_EPOCHS = 60, 4
SHARDS = [f"shard-{i:02d}" for i in range(64)]
SLOTS = 65_537
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: str = "source"):
    """The domain of a source, by the number in its name: the top of the tree that mixing works on."""
    n = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.when(n < 10, F.lit("web")).when(n < 15, F.lit("forum")).otherwise(F.lit("reference"))


# ---------------------------------------------------------------- queries


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", domain_of().alias("domain"), "lang", "source", "text")
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, budget_pct=MIX_PCT, max_epochs=MIX_EPOCHS).drop("text")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return sharding.assign_shards(docs, SHARDS, SLOTS)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), host="source", path=("source", "lang"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("text", "clean_text")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = fresh_path(spark, "token-ids")
    token_output.write_ids(table(spark, sf_dir, "documents"), out, str(public_tokenizers.path("byte_bpe_50k.json")), END_ID)
    return token_output.id_digests(token_output.read_ids(spark, out))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.drop("text")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.host_rule(*r) for r in URL_RULES] + url_filters.default_rules()
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, rules).drop("url")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    tree = merkle.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], changed=changed)
    proof, verified = F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), (F.col("folded_root") == F.col("root")).alias("verified")
    return tree.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", verified)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_quality_rules": op4_quality_rules,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_token_output": op6_token_output,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_url_filters": op9_url_filters,
        "op10_line_dedup": op10_line_dedup,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_hard_negatives": op13_hard_negatives,
    }


# ---------------------------------------------------------------- SQL

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DOMAIN = r"case when coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) as int), 0) < 10 then 'web' when coalesce(try_cast(regexp_extract(source, '(\d+)$', 1) as int), 0) < 15 then 'forum' else 'reference' end"


def _mix_sql() -> str:
    def weight(levels: list[str]) -> str:
        cases = [
            "when " + " and ".join(f"{c} = '{v}'" for c, v in zip(levels, path, strict=True)) + f" then {w}"
            for path, w in MIX_WEIGHTS.items()
            if len(path) == len(levels)
        ]
        return f"case {' '.join(reversed(cases))} else 1 end" if cases else "1"

    parts = [
        f"d as (select doc_id, {_DOMAIN} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, lang as lang0, source as source0, len({_WORDS}) as t from documents)",
        f"leaf as (select domain, lang, source, sum(t)::hugeint as t, count(*) as n, sum(t)::hugeint * {MIX_EPOCHS} as cap from d group by all)",
        f"n0 as (select least(sum(cap), sum(t) * {MIX_PCT} // 100)::hugeint as b from leaf)",
    ]
    for depth in (1, 2, 3):
        own, parent = MIX_LEVELS[:depth], MIX_LEVELS[: depth - 1]
        family = f"partition by {', '.join(parent) or '0'}"
        join = "cross join n0" if depth == 1 else f"join n{depth - 1} using ({', '.join(parent)})"
        parts += [
            f"a{depth} as (select *, {weight(own)} as w from (select {', '.join(own)}, sum(cap)::hugeint as c from leaf group by all) {join})",
            f"b{depth} as (select *, b - coalesce(sum(c) over before, 0) as left_b, sum(w) over fam - coalesce(sum(w) over before, 0) as left_w from a{depth} "
            f"window fam as ({family}), before as ({family} order by c::double / w::double, {', '.join(own)} rows between unbounded preceding and 1 preceding))",
            f"c{depth} as (select *, c * left_w <= w * left_b as is_full from b{depth})",
            f"n{depth} as (select {', '.join(own)}, (case when is_full then c else (w * (b - coalesce(sum(c) filter (is_full) over ({family}), 0))) // sum(w) filter (not is_full) over ({family}) end)::hugeint as b from c{depth})",
        ]
    parts += [
        "g as (select l.*, case when t = 0 then 0 else b // t end as epochs, b - (case when t = 0 then 0 else b // t end) * t as rest from leaf l join n3 using (domain, lang, source))",
        "o as (select d.*, g.epochs, g.rest, md5('mix:' || g.epochs || ':' || coalesce(d.doc_id::varchar, '')) as u from d join g using (domain, lang, source))",
        "r as (select *, sum(t) over (partition by domain, lang, source order by u range between unbounded preceding and current row) as upto from o)",
        "k as (select *, epochs + case when rest > 0 and upto <= rest then 1 else 0 end as times from r)",
    ]
    return f"with {', '.join(parts)} select doc_id, domain, lang0 as lang, source0 as source, unnest(range(times::bigint))::int as epoch from k where times > 0"


def _op4_sql() -> str:
    r = quality_rules.LineRules()
    marks = ", ".join("'" + m.replace("'", "''") + "'" for m in quality_rules.TERMINAL)
    phrases = " or ".join(f"contains(lower(x), '{p}')" for p in quality_rules.BOILERPLATE)
    strip = f"trim(x, {_WS})"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, {_WORDS} as w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {strip} <> '') as l from documents),
win as (select rid, p, list_slice(w, p, p + {r.window - 1}) as g from (select rid, w, unnest(range(1, len(w) - {r.window - 2})) as p from d)),
dup as (select rid, p, count(*) over (partition by rid, g) as c from win),
rep as (select rid, count(distinct p + o) as n from dup, range({r.window}) as s(o) where c > 1 group by rid),
s as (select d.rid, doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words, len(l)::bigint as n_l, list_sum(list_transform(l, lambda x: length(x)))::bigint as total,
        list_filter(l, lambda x: not (right(rtrim(x, {_WS}), 1) not in ({marks})
            or length(regexp_replace(x, '[^#*$%&|<>{{}}!~^=_]+', '', 'g')) > length(x) * {r.max_mark_share}
            or (length(regexp_replace(x, '[^{quality_rules.SEPARATORS}]+', '', 'g')) >= {r.min_separators} and length(x) < (length(regexp_replace(x, '[^{quality_rules.SEPARATORS}]+', '', 'g')) + 1) * {r.max_link_chars}) or {phrases})) as good
    from d left join rep using (rid)),
v as (select *, coalesce(total, 0) as chars_total, coalesce(total, 0) - coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) as chars_lost,
        n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_pct} * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and chars_lost <= chars_total * {r.max_lost_share} as kept,
    (n_l - len(good))::bigint as n_bad_lines, chars_total::bigint as chars_total, chars_lost::bigint as chars_lost from v"""


def _op9_sql() -> str:
    rules = ", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    own = " or ".join(f"regexp_matches(lower(host || path), '{p}')" for p, _ in url_filters.default_patterns())
    return f"""
with r(name, rh, rp, v) as (values {rules}),
a as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, rest, regexp_extract(rest, '(?s)^[^/?#]*') as raw from a),
c as (select row_number() over () as rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '(?s)^[^?#]*') as path from b),
f as (select c.*, r.name, r.v, row_number() over (partition by rid order by length(r.name) desc) as k from c left join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, name as rule, coalesce(v, case when {own} then 'block' else 'allow' end) as verdict from f where k = 1"""


_OP7_SQL = f"""
with d as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
x as (select rid, doc_id, unnest(range(1, len(w) - 11)) as p, w from d),
g as (select rid, doc_id, p, list_slice(w, p, p + 12) as g from x),
f as (select rid, p, doc_id > min(doc_id) over (partition by g) as again from g),
c as (select distinct rid, p + o as q from f, range(13) as s(o) where again),
v as (select rid, doc_id, unnest(w) as word, generate_subscripts(w, 1) as q from d),
k as (select v.rid, count(*) filter (c.q is not null) as n_removed, string_agg(word, ' ' order by v.q) filter (c.q is null) as kept from v left join c on v.rid = c.rid and v.q = c.q group by v.rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (rid)"""


_OP10_SQL = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
x as (select rid, doc_id, unnest(l) as line, generate_subscripts(l, 1) as p from d),
k as (select *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from x),
f as (select key from k where key <> '' group by key having count(distinct rid) >= 10),
m as (select k.*, f.key is not null as gone from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256 from m group by rid, doc_id"""


def _op2_sql() -> str:
    owners = ",".join(map(str, sharding.claimed_slots(SHARDS, SLOTS)))
    return f"""
with s as (select doc_id, source, lang, (('0x' || substr(md5(':' || coalesce(doc_id::varchar, '')), 1, 15))::bigint % {SLOTS})::bigint as slot from documents),
o as (select string_split('{owners}', ',') as owner)
select doc_id, source, lang, slot, 'shard-' || lpad(owner[slot + 1], 2, '0') as shard from s, o"""


_H = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_LEAF = " || ".join(_H.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))


def _op12_sql(levels: int = 24) -> str:
    """Levels of all sources at once, then those of the subroots; sibling runs by window, crc32 bit by bit."""
    crc = "list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))), 4294967295)"
    changed = f"case when doc_id is not null and {crc.replace('list_transform(', 'list_prepend(4294967295, list_transform(').replace('ord(c)::bigint)', 'ord(c)::bigint))').replace(', 4294967295)', ')')} % 2 = 1 then replace(text, chr(10), '') else text end"
    run = "partition by tree, i // 3 order by i"
    return f"""
with recursive d as (select row_number() over () as rid, *, {changed} as t2 from documents),
l as (select rid, doc_id, source, sha256({_LEAF.format(text="text")}) as leaf, sha256({_LEAF.format(text="t2")}) as leaf2 from d),
p as (select *, coalesce('+' || source, '') as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from l),
up(tree, i, n, h, k) as (
    select tree, i, n, leaf, 0 from p
    union all
    select tree, i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by i)), any_value(k) + 1 from up where n > 1 group by tree, i // 3),
g as (select tree, h, row_number() over (order by tree) - 1 as i, count(*) over () as n from up where n = 1),
top(i, n, h, k) as (
    select i, n, h, 0 from g
    union all
    select i // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' order by i)), any_value(k) + 1 from top where n > 1 group by i // 3),
nodes as (select 0 as part, tree, i, k, n, h from up union all select 1, '', i, k, n, h from top),
sib as (select part, tree, i, k, coalesce(string_agg(h, '') over (partition by part, tree, k, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as l,
        coalesce(string_agg(h, '') over (partition by part, tree, k, i // 3 order by i rows between 1 following and unbounded following), '') as r from nodes where n > 1),
fold(rid, part, tree, i, k, h, proof, g) as (
    select rid, 0, p.tree, p.i, 0, leaf2, '', g.i from p join g using (tree)
    union all
    select f.rid, case when s.i is null then 1 else f.part end, case when s.i is null then '' else f.tree end, case when s.i is null then g else f.i // 3 end,
        case when s.i is null then 0 else f.k + 1 end, case when s.i is null then f.h else sha256(s.l || f.h || s.r) end,
        case when s.i is null then proof else proof || s.l || s.r end, g
    from fold f left join sib s on s.part = f.part and s.tree = f.tree and s.i = f.i and s.k = f.k where s.i is not null or f.part = 0),
e as (select rid, h, proof from fold f where part = 1 and not exists (select 1 from sib s where s.part = 1 and s.i = f.i and s.k = f.k)),
r as (select h as root from top where n = 1)
select doc_id, leaf, g.h as subroot, root, sha256(proof) as proof_sha256, e.h as folded_root, e.h = root as verified from p join g using (tree) join e using (rid), r"""


_OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
    where label is not null and embedding is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_sum(list_transform(list_zip(a.w, b.w), lambda z: z[1] * z[2]))::bigint as score
    from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.*, other_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::int as rank
    from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": _mix_sql(),
        "op2_sharding": _op2_sql(),
        "op4_quality_rules": _op4_sql(),
        "op9_url_filters": _op9_sql(),
        "op7_substring_dedup": _OP7_SQL,
        "op10_line_dedup": _OP10_SQL,
        "op12_merkle_manifest": _op12_sql(),
        "op13_hard_negatives": _OP13_SQL,
    }
