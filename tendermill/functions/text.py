"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

# Labels of units that name a package.
PACKAGE_UNITS = [
    "pacote", "pcte", "pct", "caixa", "cx", "resma", "fardo", "frd", "duzia", "dz", "cento", "ct", "rolo", "rl", "kit", "conjunto", "conj",
    "bloco", "bl", "galao", "jogo", "par", "embalagem", "emb", "saco", "sacola", "frasco", "pote", "garrafa", "balde", "bombona",
]
# Words that say nothing in a catalog search.
STOP_WORDS = ["DE", "DA", "DO", "DAS", "DOS", "PARA", "COM", "SEM", "E", "OU", "A", "O", "AS", "OS", "EM", "NO", "NA"]
# Abbreviations of qualification documents.
ABBREVIATIONS = {
    "cnd": "certidao negativa de debitos",
    "crf": "certificado de regularidade certidao regularidade fgts",
    "cndt": "certidao negativa de debitos trabalhistas",
    "pgfn": "procuradoria geral da fazenda nacional",
    "sicaf": "sistema de cadastramento unificado de fornecedores",
    "me epp": "microempresa empresa de pequeno porte",
}
# Fixed value: a package and the number of pieces in it; the number is in group 1, 2 or 3.
PACKAGE_PATTERN = (
    r"(?iu)(?:caixa|cx|pacote|pct|kit|fardo|embalagem)\s*(?:com|c/)?\s*(\d+)\s*(?:unidades?|und?|un\.?|pe[cç]as?|folhas?)?\b"
    r"|(?:com|c/)\s*(\d+)\s*(?:unidades?|und?|un\.?|pe[cç]as?|folhas?)\b|\(\s*(\d+)\s*(?:unidades?|und?|un\.?)\s*\)"
)
#: ASCII signs that are in no word.
_NO_WORD = "".join(c for c in map(chr, range(128)) if c not in "abcdefghijklmnopqrstuvwxyz0123456789")


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Signs whose compatibility form has one ASCII sign, those signs, and the others' longer ASCII forms."""
    single, plain, longer = [], [], {}
    for sign in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]):
        if not unicodedata.decomposition(sign):
            continue
        flat = unicodedata.normalize("NFKD", sign).encode("ascii", "ignore").decode()
        if len(flat) == 1:
            single.append(sign)
            plain.append(flat)
        elif flat:
            longer[sign] = flat
    return "".join(single), "".join(plain), longer


def _ascii(text: Column) -> Column:
    """Compatibility decomposition, then only its ASCII part. Texts with a sign of a longer form (``½``, ``㎡``) are spelled out sign by sign."""
    single, plain, longer = _decompositions()
    forms = F.str_to_map(F.lit("\x02".join(f"{sign}\x01{form}" for sign, form in longer.items())), F.lit("\x02"), F.lit("\x01"))
    signs = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelled = F.array_join(F.transform(signs, lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.coalesce(F.try_element_at(forms, c), c))), "")
    # deleting the signs tells whether there are any faster than a class of hundreds of them
    some = F.when(F.length(F.translate(text, "".join(longer), "")) < F.length(text), spelled).otherwise(text)
    flat = F.regexp_replace(F.translate(some, single, plain), r"[^\x00-\x7F]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(flat)


def normalize(text: Column) -> Column:
    """Accents and marks off, lower case, one space between words; '' for a null."""
    # marks and white space are told sign by sign, as that is much cheaper than a pattern, which only texts with a run of spaces get
    low = F.translate(F.lower(_ascii(F.coalesce(text, F.lit("")))), _NO_WORD, " " * len(_NO_WORD))
    whole = F.trim(low)
    return F.when(F.contains(whole, F.lit("  ")), F.regexp_replace(whole, " +", " ")).otherwise(whole)


def normalize_light(text: Column) -> Column:
    """Accents off and lower case, marks kept; '' for a null."""
    return F.lower(_ascii(F.coalesce(text, F.lit(""))))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def product_text(description: Column, keywords: Column) -> Column:
    base = F.trim(F.coalesce(description, F.lit("")))
    return F.when(F.coalesce(keywords, F.lit("")) == "", base).otherwise(F.concat(base, F.lit(" ("), F.trim(keywords), F.lit(")")))


def expand_abbreviations(text: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Normalized text with abbreviations spelled out, the longest first."""
    out = normalize(text)
    for short in sorted(table, key=len, reverse=True):
        out = F.replace(out, F.lit(short), F.lit(table[short]))
    return out


def contains_all_tokens(field: Column, tokens: Column) -> Column:
    """Every token is somewhere in the field, and there is one at least."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.contains(field, t))


def search_tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: F.length(t) >= 2)


def significant_words(text: Column) -> Column:
    return F.filter(F.split(F.upper(F.trim(text)), r"\s+"), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def first_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).try_cast("int")


def is_package_unit(text: Column) -> Column:
    return F.coalesce(normalize(text).isin(PACKAGE_UNITS), F.lit(False))


def package_count(description: Column) -> Column:
    """Pieces in a package by its description, or null. The pattern is tried once: what it finds holds one number."""
    return F.regexp_extract(F.regexp_extract(description, PACKAGE_PATTERN, 0), r"\d+", 0).try_cast("int")


def unit_price(description: Column, price: Column) -> Column:
    """Price of a piece; null unless the price is positive."""
    # the count stands here once, as it is taken again wherever it stands
    return F.when(price > 0, price / F.greatest(F.coalesce(package_count(description), F.lit(1)), F.lit(1)))


def chunk(texts: DataFrame, text: str = "texto", size: int = 2500) -> DataFrame:
    """``idx`` and ``parte`` for each piece of ``size`` characters; a null or empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(F.col(text), i * size + 1, F.lit(size))))
    return texts.select("*", F.posexplode(parts).alias("idx", "parte")).drop(text)


def clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def drop_replacement_char(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(""))


def _indel(a: str, b: str) -> int:
    """Insertions and deletions between two strings, by the longest common subsequence in bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def _indel_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_indel(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def token_set_ratio(pairs: DataFrame, a: str, b: str, out: str = "ratio", floor: Column | None = None) -> DataFrame:
    """``pairs`` with the token-set similarity (0 to 1) of columns ``a`` and ``b``; 0 where either has no token.

    All but the edit distance of the two rests is expressed in columns; the distance is an Arrow function over distinct rests only. With
    a ``floor`` (of each pair) no distance is taken where lengths rule out that the ratio reaches it; such a pair's ratio may come
    out smaller than it is.
    """
    ship(pairs.sparkSession)
    indel = F.pandas_udf(_indel_batch, "long")

    def tokens(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.array_remove(F.split(F.coalesce(F.col(c), F.lit("")), r"\s+"), "")))

    def size(c: str) -> Column:
        return F.length(F.array_join(F.col(c), " "))

    t = pairs.withColumns({"__ts_a": tokens(a), "__ts_b": tokens(b)})
    t = t.withColumns({"__ts_s": F.array_intersect("__ts_a", "__ts_b"), "__ts_x": F.array_except("__ts_a", "__ts_b"), "__ts_y": F.array_except("__ts_b", "__ts_a")})
    empty = (F.size("__ts_a") == 0) | (F.size("__ts_b") == 0)
    inside = (F.size("__ts_s") > 0) & ((F.size("__ts_x") == 0) | (F.size("__ts_y") == 0))
    t = t.withColumns({"__ts_easy": F.when(empty, F.lit(0.0)).when(inside, F.lit(1.0)), "__ts_xs": F.array_join("__ts_x", " "), "__ts_ys": F.array_join("__ts_y", " ")})
    s, x, y = size("__ts_s"), size("__ts_x"), size("__ts_y")
    g = F.when(F.size("__ts_s") > 0, F.lit(1)).otherwise(F.lit(0))
    hard = t.filter(F.col("__ts_easy").isNull())
    if floor is not None:
        hard = hard.filter(1 - F.abs(x - y) / ((s + g + x) + (s + g + y)) >= floor - 1e-9)
    far = hard.select("__ts_xs", "__ts_ys").distinct().withColumn("__ts_d", indel("__ts_xs", "__ts_ys"))
    t = t.join(far, ["__ts_xs", "__ts_ys"], "left")
    whole = 1 - F.col("__ts_d") / ((s + g + x) + (s + g + y))
    rest = [1 - (g + n) / (s + s + g + n) for n in (x, y)]
    ratio = F.coalesce("__ts_easy", F.when(g == 0, whole).otherwise(F.greatest(whole, *rest)), F.lit(0.0))
    return t.withColumn(out, ratio).drop("__ts_a", "__ts_b", "__ts_s", "__ts_x", "__ts_y", "__ts_easy", "__ts_xs", "__ts_ys", "__ts_d")
