"""Record sources and sinks.

Explicit schemas everywhere (no inference in production paths).  Spark reads a
whole-file JSON array by one task (``read_json_array``); ``json_array.scan_json_array``
cuts it by blocks, and ``json_array_to_lines`` writes it as JSON lines that way.
"""

from __future__ import annotations

import ast
import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import with_record_id
from ..session import scratch_path


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet source (column pruning and filters reach the scan)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file holding one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_ndjson(spark: SparkSession, path: str | list[str], schema: T.StructType | str,
                corrupt_column: str | None = None, position: str | None = None) -> DataFrame:
    """S3: JSON lines; blank lines are skipped.  With ``corrupt_column`` bad
    lines are kept with their raw text (PERMISSIVE mode).

    With ``position`` each row also gets its place in the files as a column of
    that name, ``STRUCT<file, block, place>`` in the order of paths, of blocks
    within a file, and of lines within a block.  It comes from the scan's file
    metadata, so no row moves for it; ``last_wins`` and ``match_records`` take
    it as their ``seq`` (the last line of the last file wins)."""
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt_column:
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_column, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", corrupt_column)
    rows = reader.schema(schema).json(path)
    if position is None:
        return rows
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     # rows of a block follow each other in one task, so this rises within a block
                     F.monotonically_increasing_id().alias("place"))
    return rows.select("*", place.alias(position))


def number_lines(df: DataFrame, position: str = "seq", name: str = "line") -> DataFrame:
    """A dense 1-based number of each row within its file, from the column
    that ``read_ndjson(position=...)`` adds.

    The rows are written once to the session's scratch folder (a place is only
    fixed within one run of the scan); rows are counted by block with partial
    aggregates, blocks are summed up within their file, and each row takes its
    block's offset: no window over rows, none over more than one file's blocks, and no row moves."""
    path = scratch_path(df.sparkSession, "lines")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    at = F.col(position)
    key = F.struct(at["file"].alias("file"), at["block"].alias("block"))
    blocks = stored.groupBy(key.alias("_gt_block")).agg(F.max(at["place"]).alias("_gt_last"), F.count(F.lit(1)).alias("_gt_n"))
    before = Window.partitionBy("_gt_block.file").orderBy("_gt_block.block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = blocks.select("_gt_block", "_gt_last", F.sum("_gt_n").over(before).alias("_gt_upto"))
    joined = stored.withColumn("_gt_block", key).join(F.broadcast(ends), "_gt_block")     # one small row a block
    return joined.select(*df.columns, (F.col("_gt_upto") - (F.col("_gt_last") - at["place"])).alias(name))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header and quoted multi-line fields."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink readable by ``read_csv`` (quotes doubled, not backslashed)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite", keep_nulls: bool = True) -> None:
    """One result object per line; null fields are written as ``null``
    like the reference does."""
    df.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_gold(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Gold as a directory of JSON lines or Parquet (a single JSON array
    file would funnel all rows through one writer)."""
    w = df.write.mode(mode)
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S7."""
    df.write.mode(mode).parquet(path)


def json_array_to_lines(spark: SparkSession, src: str, dst: str, schema) -> DataFrame:
    """S2 once, by as many tasks as the array has blocks, then S5."""
    from .json_array import scan_json_array

    write_ndjson(scan_json_array(spark, src, schema), dst)
    return read_ndjson(spark, dst, schema)


def _literal_to_json(text):
    if text is None:
        return "{}"
    if isinstance(text, dict):
        return json.dumps(text)
    value = ast.literal_eval(text)
    if value is None:
        return "{}"
    return json.dumps(value)


@F.pandas_udf(T.StringType())
def py_literal_to_json(texts: pd.Series) -> pd.Series:
    """Python-literal text (single quotes, None, True) to JSON text."""
    return texts.map(_literal_to_json)


def parse_py_literal(c: Column, schema: T.DataType | str) -> Column:
    """Python-literal text to a nested value; null becomes an empty
    object.  ``from_json`` alone would read single quotes but turns a row
    holding ``None`` into null without an error, hence the Arrow-batched
    conversion first."""
    return F.from_json(py_literal_to_json(c), schema)


def materialize_gold(df: DataFrame, path: str, refresh: bool = False, fmt: str = "json") -> bool:
    """Build gold if it is absent, or again on request; whether it was built.

    Gold is written to a staging folder beside ``path`` and moved there when
    whole, so a job that fails half-way leaves ``path`` as it was, and a reader
    never meets half a table.  Gold is there if its ``_SUCCESS`` mark is; what
    lies at ``path`` without the mark (an old, broken write) is replaced.  Of two
    builders at once, one publishes; the other drops its copy and returns false
    (with ``refresh``: the later one stays)."""
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    target, token = hadoop(path), uuid.uuid4().hex
    fs = target.getFileSystem(context._jsc.hadoopConfiguration())
    built = lambda: fs.exists(hadoop(target, "_SUCCESS"))
    if built() and not refresh:
        return False
    beside = lambda kind: hadoop(target.getParent(), f"_{target.getName()}-{kind}-{token}")
    staged, replaced = beside("staging"), beside("replaced")
    try:
        write_gold(df, staged.toString(), fmt=fmt, mode="error")
        if fs.exists(target):
            if built() and not refresh:
                return False
            fs.rename(target, replaced)
        if not fs.rename(staged, target):
            raise OSError(f"gold could not be moved to {path}")
        nested = hadoop(target, staged.getName())
        if fs.exists(nested):   # another builder published in between: a move into a folder that exists goes below it
            fs.delete(nested, True)
            return False
        return True
    finally:
        for left in (staged, replaced):
            fs.delete(left, True)


def gold_with_key(df: DataFrame, order_by: list, columns: list[str], key: str = "record_id") -> DataFrame:
    """Attach the 1-based record key (K1) while building gold."""
    return with_record_id(df, order_by, name=key).select(key, *columns)
