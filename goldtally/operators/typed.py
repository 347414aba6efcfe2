"""X8 path by path: JSON text to a declared shape, with one failure for each
value of another type.

``from_json`` turns a whole record null, or a value silently into text, where
a model answers ``"year": "2019"`` for a number.  Here the text is parsed to a
VARIANT once, and a Column built from the declared schema walks it: each value
that fits is kept, each that does not becomes null and leaves
``STRUCT<path, expected, found>``, with list positions in the path
(``insured_objects[2].year``).  Everything stays in the JVM.

Defined cases: null text gives a null value and no failure; malformed text a
null value and one failure at ``$``; a missing field or a JSON null is null
and no failure (``validate.required`` is its own check); a field that the
schema does not name is ignored; an empty list stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import let

FAILURE = "struct<path:string,expected:string,found:string>"

# The kinds of JSON value, as Spark names them, that a type takes.
_WHOLE = ["BIGINT", "DECIMAL"]
_NUMBER = ["BIGINT", "DECIMAL", "DOUBLE"]
_KINDS = {"string": ["STRING"], "boolean": ["BOOLEAN"], "date": ["STRING"], "tinyint": _WHOLE, "smallint": _WHOLE,
          "int": _WHOLE, "bigint": _WHOLE, "float": _NUMBER, "double": _NUMBER}


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _none() -> Column:
    return F.array().cast(f"array<{FAILURE}>")


def _failure(path: Column, expected: str, found: Column) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(expected).alias("expected"), found.alias("found"))).cast(f"array<{FAILURE}>")


def _leaf(v: Column, kind: T.DataType, path: Column) -> Column:
    name = kind.simpleString()
    takes = _NUMBER if isinstance(kind, T.DecimalType) else _KINDS.get(name)
    if takes is None:
        raise ValueError(f"no JSON value has the type {name}")
    if isinstance(kind, T.DateType):
        value = F.try_to_date(F.try_variant_get(v, "$", "string"), "yyyy-MM-dd")
    else:
        value = F.try_variant_get(v, "$", name)
    if takes is _WHOLE:   # 3.5 is no whole number, and is not cut to 3
        value = F.when(F.try_variant_get(v, "$", "decimal(38,10)") == value, value)

    def judged(x: Column) -> Column:
        fits = x["kind"].isin(takes) & x["value"].isNotNull()
        empty = x["kind"].isNull() | (x["kind"] == "VOID")
        return F.struct(F.when(fits, x["value"]).alias("value"),
                        F.when(fits | empty, _none()).otherwise(_failure(path, name, x["kind"])).alias("failures"))

    return let(F.struct(_kind(v).alias("kind"), value.alias("value")), judged)


def _step(name: str) -> str:
    if '"' in name:
        raise ValueError(f"field name with a quotation mark: {name}")
    return f'$["{name}"]'


def _node(v: Column, kind: T.DataType, path: Column, root: bool = False) -> Column:
    """``STRUCT<value, failures>`` of one variant against one declared type."""
    null_of = lambda: F.lit(None).cast(kind)

    def other(expected: str) -> Column:
        """No value; a failure unless the value is missing or a JSON null."""
        empty = v.isNull() | F.is_variant_null(v)
        return F.struct(null_of().alias("value"),
                        F.when(empty, _none()).otherwise(_failure(path, expected, _kind(v))).alias("failures"))

    if isinstance(kind, T.StructType):
        under = lambda f: F.lit(f.name) if root else F.concat(path, F.lit("." + f.name))
        fields = F.struct(*[_node(F.try_variant_get(v, _step(f.name), "variant"), f.dataType, under(f)).alias(f"f{i}")
                            for i, f in enumerate(kind.fields)])
        whole = let(fields, lambda x: F.struct(
            F.struct(*[x[f"f{i}"]["value"].alias(f.name) for i, f in enumerate(kind.fields)]).cast(kind).alias("value"),
            F.concat(*[x[f"f{i}"]["failures"] for i in range(len(kind.fields))]).alias("failures")))
        return F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), whole).otherwise(other("object"))
    if isinstance(kind, T.ArrayType):
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _node(x, kind.elementType, at(i)))
        whole = let(items, lambda xs: F.struct(F.transform(xs, lambda x: x["value"]).cast(kind).alias("value"),
                                               F.flatten(F.transform(xs, lambda x: x["failures"])).alias("failures")))
        return F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), whole).otherwise(other("array"))
    return _leaf(v, kind, path)


def parse_by_path(raw: Column, schema: T.StructType | str) -> Column:
    """``STRUCT<value: schema, failures: ARRAY<STRUCT<path, expected, found>>>``."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    def parsed(v: Column) -> Column:
        malformed = F.struct(F.lit(None).cast(schema).alias("value"), _failure(F.lit("$"), "JSON", F.lit("malformed")).alias("failures"))
        nothing = F.struct(F.lit(None).cast(schema).alias("value"), _none().alias("failures"))
        return (F.when(raw.isNull(), nothing).when(v.isNull(), malformed)
                .otherwise(_node(v, schema, F.lit("$"), root=True)))

    return let(F.try_parse_json(raw), parsed)
