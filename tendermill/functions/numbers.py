"""Numbers, money, vectors and dates as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units of one family and their factor to the smallest of it.
UNIT_FAMILIES = [
    ("litros", "volume", 1000.0), ("ml", "volume", 1.0), ("kg", "massa", 1000.0), ("gramas", "massa", 1.0),
    ("tb", "armazenamento", 1_000_000.0), ("gb", "armazenamento", 1_000.0), ("mb", "armazenamento", 1.0),
    ("cm", "comprimento", 10.0), ("mm", "comprimento", 1.0), ("m", "comprimento", 1000.0),
]


def rounded(value: Column | str, n: int) -> Column:
    """A double rounded half up by its decimal value, so that engines agree on ties."""
    return F.round((F.col(value) if isinstance(value, str) else value).cast("decimal(20,8)"), n).cast("double")


def rounded_column(name: str, n: int) -> Column:
    """``rounded`` of a column of small numbers, for very many rows: decimals are only made where a tie is near, or the number is large or none."""
    x = F.col(name)
    whole = F.abs(x) * F.lit(10.0**n)
    apart = F.abs(whole - F.floor(whole) - 0.5) > 10.0 ** (n - 8) + 1e-4
    near = F.floor(whole + 0.5).cast("double") / F.lit(10.0**n)
    return F.when((F.abs(x) < 1000.0) & apart, F.when(x < 0, 0.0 - near).otherwise(near) + 0.0).otherwise(rounded(x, n))


def parse_br_number(text: Column) -> Column:
    """``R$ 1.234,56`` as a double; a dot groups thousands only if there is a comma. Null if it is no number."""
    bare = F.trim(F.replace(F.replace(text.cast("string"), F.lit("R$"), F.lit("")), F.lit(" "), F.lit("")))
    plain = F.when(F.contains(bare, F.lit(",")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    return plain.try_cast("double")


def format_brl(value: Column) -> Column:
    """``R$ 1.234,56``; null for a null or zero."""
    return F.when(value != 0, F.concat(F.lit("R$ "), F.translate(F.format_number(value, 2), ",.", ".,")))


def place_label(city: Column, state: Column) -> Column:
    return F.concat_ws("/", F.nullif(city, F.lit("")), F.nullif(state, F.lit("")))


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value.cast("double"), F.lit(0.0)), F.lit(1.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for empty ones or different lengths; a zero norm counts as 1."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    def norm(x: Column) -> Column:
        n = F.sqrt(dot(x, x))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    fit = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fit, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def vector_norm(v: Column) -> Column:
    """The norm of a vector of doubles; 1 for a zero norm."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def to_family(df: DataFrame, unit: str = "unidade", value: str = "valor") -> DataFrame:
    """``df`` with ``familia`` and ``valor_canon``; an unknown unit is a family of its own."""
    names = F.create_map(*[F.lit(x) for u, f, _ in UNIT_FAMILIES for x in (u, f)])
    factors = F.create_map(*[F.lit(x) for u, _, k in UNIT_FAMILIES for x in (u, k)])
    return df.withColumns(
        {
            "familia": F.coalesce(F.try_element_at(names, F.col(unit)), F.col(unit)),
            "valor_canon": F.col(value) * F.coalesce(F.try_element_at(factors, F.col(unit)), F.lit(1.0)),
        }
    )


def parse_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "dd/MM/yyyy")) -> Column:
    """The date of the first format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("date")


def to_local(ts: Column, zone: str = "America/Sao_Paulo") -> Column:
    return F.from_utc_timestamp(ts, zone)


def days_left(day: Column, as_of: dt.date) -> Column:
    return F.date_diff(day, F.lit(as_of))


def week_start(day: Column, offset: int = 0) -> Column:
    """The Sunday of the day's week, ``offset`` weeks on."""
    return F.date_add(F.date_sub(day, F.dayofweek(day) - 1), 7 * offset)


def day_series(spark: SparkSession, start: dt.date, n: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(start + dt.timedelta(days=n - 1)))).alias("data"))
