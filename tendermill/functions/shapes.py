"""Answers of any shape as fixed columns: a VARIANT is brought to a schema, field by field, whatever stands where."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is taken once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kind(v: Column) -> Column:
    """null, void, boolean, number, text, list or object; ``whole`` for a whole number."""
    return _bound(
        F.schema_of_variant(v),
        lambda name: (
            F.when(name.isNull() | (name == "VOID"), "void").when(name == "BOOLEAN", "boolean").when(name == "STRING", "text").when(name == "BIGINT", "whole")
            .when(F.startswith(name, F.lit("ARRAY")), "list").when(F.startswith(name, F.lit("OBJECT")), "object").otherwise("number")
        ),
    )


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _filled(v: Column, kind: Column) -> Column:
    full = (
        F.when(kind == "void", False).when(kind == "boolean", _as(v, "boolean")).when(kind.isin("number", "whole"), _as(v, "double") != 0).when(kind == "text", _as(v, "string") != "")
        .when(kind == "list", F.size(_as(v, "array<variant>")) > 0).when(kind == "object", F.size(_as(v, "map<string,variant>")) > 0)
    )
    return F.coalesce(full, F.lit(False))


def _written_out(v: Column, kind: Column) -> Column:
    return (
        F.when(kind == "void", "None").when(kind == "boolean", F.when(_as(v, "boolean"), "True").otherwise("False"))
        .when(kind == "whole", _as(v, "string")).when(kind == "number", _as(v, "double").cast("string"))
        .when(kind == "text", _as(v, "string")).otherwise(F.to_json(v))
    )


def _known(v: Column, use: Callable[[Column, Column], Column], missing: Column) -> Column:
    """``use`` of a value and its kind, each taken once; ``missing`` where there is no value."""
    return _bound(v, lambda x: F.when(x.isNull(), missing).otherwise(_bound(_kind(x), lambda kind: use(x, kind))))


def filled(v: Column) -> Column:
    """Whether a value says anything: not null, false, zero, or an empty text, list or object."""
    return _known(v, _filled, F.lit(False))


def written_out(v: Column) -> Column:
    """A value as text: truth values and null by their names, whole numbers without a point, lists and objects as JSON."""
    return _known(v, _written_out, F.lit("None"))


def shaped(v: Column, schema: T.DataType) -> Column:
    """``v`` as ``schema``: texts, lists of texts, flags, and groups of these to any depth.

    What is missing or of another shape has a defined result: a text is '' where nothing is said, else the value written out; a list
    is the values of a list, or the one value given, or empty; a flag tells whether something is said; a group that is no object
    has its fields as if all were missing. Fields that the schema doesn't name are left out.
    """
    if isinstance(schema, T.StructType):
        return _bound(v, lambda x: F.struct(*[shaped(F.try_variant_get(x, f"$.{f.name}", "variant"), f.dataType).alias(f.name) for f in schema.fields]))
    if isinstance(schema, T.ArrayType):
        none = F.array().cast("array<string>")
        return _known(v, lambda x, kind: F.when(kind == "list", F.transform(_as(x, "array<variant>"), written_out)).when(_filled(x, kind), F.array(_written_out(x, kind))).otherwise(none), none)
    if isinstance(schema, T.BooleanType):
        return filled(v)
    if isinstance(schema, T.StringType):
        return _known(v, lambda x, kind: F.when(_filled(x, kind), _written_out(x, kind)).otherwise(""), F.lit(""))
    raise ValueError(f"no shape for {schema.simpleString()}")


def is_object(v: Column) -> Column:
    return _kind(v) == "object"
