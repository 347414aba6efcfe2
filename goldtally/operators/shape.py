"""Projections, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """P1."""
    return df.select(*fields)


def where_contains(df: DataFrame, column: str, pattern: str, regex: bool = True) -> DataFrame:
    """Substring / regex filter (the reference's ``str.contains`` is a regex)."""
    c = F.col(column)
    return df.where(c.rlike(pattern) if regex else c.contains(pattern))


def row_count(df: DataFrame) -> DataFrame:
    """P3 as a one-row DataFrame (no driver-side action)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def prefer_renamed(new: Column, old: Column) -> Column:
    """Take the section under its new name, else the old one."""
    return F.coalesce(new, old)


def nested(path: str) -> Column:
    """P5: null-safe nested read of a dotted path."""
    return F.col(path)


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every nested struct leaf becomes a top-level column named by its
    dotted path; lists are kept as they are.  Built from the schema while
    planning -- one projection, no per-row work."""
    cols = []

    def walk(dtype: T.DataType, path: list[str]):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(f.dataType, path + [f.name])
        else:
            ref = F.col(".".join(f"`{p}`" for p in path))
            cols.append(ref.alias(sep.join(path)))

    walk(df.schema, [])
    return df.select(*cols)


def put_key(struct_col: Column, key: Column, name: str = "record_id") -> Column:
    """Set the key inside a nested struct."""
    return struct_col.withField(name, key)


def null_if_all_null(items: Column, element_type: T.StructType) -> Column:
    """A non-empty list whose every element has only null fields becomes
    null (an empty list stays as it is)."""
    def all_null(x):
        fields_null = F.lit(True)
        for f in element_type.fields:
            fields_null = fields_null & x[f.name].isNull()
        return x.isNull() | fields_null
    return F.when((F.size(items) > 0) & F.forall(items, all_null), F.lit(None)).otherwise(items)


def enum_values(c: Column) -> Column:
    """Enum members are plain strings in Spark already."""
    return c


def empty_to_null(items: Column) -> Column:
    """P10."""
    return F.when(F.size(items) > 0, items)


def typed_null(dtype) -> Column:
    """Constant null column of a given type."""
    return F.lit(None).cast(dtype)
