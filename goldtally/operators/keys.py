"""Record keys, slices and order (K1-K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path

KEY = "record_id"


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _positions(laid_out: DataFrame, name: str, offset: int) -> DataFrame:
    """Number rows by partition, then by place in it.

    The layout is written once to the session's scratch folder, with each row's
    partition and place, and both branches read that one layout: the counts per
    partition (a broadcast of one row per partition, not of data) and the rows.
    Planning the two branches over the same exchange would not do: each prunes
    other columns, so Spark samples and bounds its ranges twice.
    """
    tagged = laid_out.withColumn("_gt_pid", F.spark_partition_id()).withColumn("_gt_mid", F.monotonically_increasing_id())
    path = scratch_path(laid_out.sparkSession, "positions")
    tagged.write.parquet(path)
    stored = laid_out.sparkSession.read.schema(tagged.schema).parquet(path)
    per_part = stored.groupBy("_gt_pid").agg(F.count(F.lit(1)).alias("_gt_n"), F.min("_gt_mid").alias("_gt_first"))
    w = Window.orderBy("_gt_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_gt_pid", "_gt_first", F.coalesce(F.sum("_gt_n").over(w), F.lit(0)).alias("_gt_before"))
    return (stored.join(F.broadcast(offsets), "_gt_pid")
            .withColumn(name, (F.col("_gt_before") + F.col("_gt_mid") - F.col("_gt_first") + F.lit(offset)).cast("long"))
            .drop("_gt_pid", "_gt_mid", "_gt_first", "_gt_before"))


def with_record_id(df: DataFrame, order_by: list, name: str = KEY, offset: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """K1: a dense 1-based position of every row under a total order.

    No single-partition window: rows are range-partitioned on the order key
    and sorted inside each partition, and that layout is written once and
    numbered (this runs a job).  The order must be total: add a unique column
    to break ties.
    """
    order = _cols(order_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _positions(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name, offset)


def with_row_index(df: DataFrame, name: str = KEY, offset: int = 1) -> DataFrame:
    """K1 without an order key: position in the input's own partition order
    (file order for a freshly read file), numbered by Spark alone."""
    return _positions(df, name, offset)


def slice_records(df: DataFrame, start: int, end: int | None = None,
                  key: str = KEY, require_order: bool = True) -> DataFrame:
    """K2: inclusive 1-based slice on a stored key (pushed to the scan)."""
    if start < 1:
        raise ValueError("start must be >= 1")
    if end is not None and require_order and start > end:
        raise ValueError("start must be <= end")
    cond = F.col(key) >= start
    if end is not None:
        cond = cond & (F.col(key) <= end)
    return df.where(cond)


def order_by_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """K3: display order (also by a nested key such as 'patient.record_id')."""
    return df.orderBy(F.col(key))


def default_key(df: DataFrame, position: str, key: str = KEY) -> DataFrame:
    """K4: the key defaults to the record's position where it is missing."""
    if key in df.columns:
        return df.withColumn(key, F.coalesce(F.col(key), F.col(position)))
    return df.withColumn(key, F.col(position))


def last_wins(df: DataFrame, key: str = KEY, seq: str = "seq") -> DataFrame:
    """K5: one row per key, the one with the greatest ``seq``.

    ``max_by`` aggregates partially before the shuffle, so a key repeated
    millions of times sends one row per map task, not all of its copies.  A
    null ``seq`` comes before any other; it never makes a row of nulls."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), F.struct(F.col(seq).isNotNull(), F.col(seq))).alias("_gt_row"))
    return picked.select(key, *[F.col("_gt_row")[c].alias(c) for c in others])


def drop_keyless(df: DataFrame, key: str = KEY) -> DataFrame:
    """K6: predictions without a key cannot be matched."""
    return df.where(F.col(key).isNotNull())


def fetch(df: DataFrame, ids, key: str = KEY) -> DataFrame:
    """K7: records by key (one id or a list)."""
    if isinstance(ids, (list, tuple, set)):
        return df.where(F.col(key).isin(list(ids)))
    return df.where(F.col(key) == ids)


# --- K2 and K7 on a stored key -----------------------------------------------------

_BOUNDS = "_key_bounds"


def store_by_key(df: DataFrame, path: str, key: str = KEY, num_partitions: int | None = None) -> None:
    """Write records in ranges of their key, with the key bounds of each file.

    Rows are range-partitioned on the key (rows of one key beyond a partition's
    share are split by their place in the input, so a hot key does not fill one
    task), sorted, and written; one row a file with its least and greatest key
    lies beside them in a hidden folder.  A null key is kept and in no slice."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    laid_out = df.withColumn("_gt_place", place).repartitionByRange(n, F.col(key), F.col("_gt_place"))
    laid_out.sortWithinPartitions(key).drop("_gt_place").write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    bounds = stored.groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file")).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"))
    bounds.coalesce(1).write.parquet(f"{path.rstrip('/')}/{_BOUNDS}")


def _files_with(spark: SparkSession, path: str, cond: Column) -> DataFrame:
    """The stored records in files whose bounds meet ``cond`` (one small row a file is looked at)."""
    base = path.rstrip("/")
    bounds = spark.read.parquet(f"{base}/{_BOUNDS}")
    files = [f"{base}/{r['file']}" for r in bounds.where(cond).select("file").toLocalIterator()]
    schema = spark.read.parquet(base).schema
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def read_slice(spark: SparkSession, path: str, start: int, end: int | None = None, key: str = KEY) -> DataFrame:
    """K2 on records stored by ``store_by_key``: only files that can hold the slice are read."""
    cond = F.col("hi") >= start
    if end is not None:
        cond = cond & (F.col("lo") <= end)
    return slice_records(_files_with(spark, path, cond), start, end, key=key)


def read_records_by_key(spark: SparkSession, path: str, ids, key: str = KEY) -> DataFrame:
    """K7 on records stored by ``store_by_key``: one id or a list of them, as ``fetch``."""
    wanted = sorted(ids) if isinstance(ids, (list, tuple, set)) else [ids]
    if not wanted:
        return _files_with(spark, path, F.lit(False))
    some = F.exists(F.array(*[F.lit(i) for i in wanted]), lambda i: (i >= F.col("lo")) & (i <= F.col("hi")))
    return fetch(_files_with(spark, path, some), wanted, key)
