"""Output validation (X8-X11): typed parse, schema checks, identifier
patterns, named assertions.  All checks are boolean Columns evaluated in one
projection; counts come from a single aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def parse_typed(raw: Column, schema: T.StructType) -> Column:
    """Typed parse of model text; malformed text keeps its raw form in
    ``_corrupt_record`` (PERMISSIVE) instead of failing the job."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    return F.from_json(raw, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def allowed(c: Column, values: list[str]) -> Column:
    """Value in the allowed set (null passes: optional field)."""
    return c.isNull() | c.isin(values)


def required(c: Column) -> Column:
    return c.isNotNull()


def min_length(c: Column, n: int = 1) -> Column:
    return c.isNull() | (F.length(c) >= n)


def is_integer(c: Column) -> Column:
    return c.isNull() | c.cast("string").rlike(r"^\s*[+-]?[0-9]+\s*$")


def is_iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` that is a real calendar date."""
    return c.isNull() | (c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(c, "yyyy-MM-dd").isNotNull())


def in_range(c: Column, lo=None, hi=None) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (c >= lo)
    if hi is not None:
        cond = cond & (c <= hi)
    return c.isNull() | cond


def matches(c: Column, pattern: str) -> Column:
    """Identifier spelling (reported as a warning)."""
    return c.isNull() | c.rlike(pattern)


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Long table ``key, rule`` of failed checks (only failures are produced)."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]),
                      lambda x: x.isNotNull())
    return df.select(key, F.explode(failed).alias("rule"))


def check_assertions(df: DataFrame, assertions: dict[str, Column]) -> DataFrame:
    """X11: ``name, n_pass, n_fail`` for named predicates, in one aggregate
    (a null predicate counts as a failure)."""
    aggs = []
    for i, (name, c) in enumerate(assertions.items()):
        ok = F.coalesce(c, F.lit(False))
        aggs += [F.count(F.when(ok, 1)).alias(f"p{i}"), F.count(F.when(~ok, 1)).alias(f"f{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"p{i}").alias("n_pass"),
                              F.col(f"f{i}").alias("n_fail")) for i, name in enumerate(assertions)])
    return wide.select(F.inline(rows))
