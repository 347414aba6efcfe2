"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldtally.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the session's shared scratch folder and read it back.

    This cuts the lineage: what follows is recomputed from shared files, not
    from the executors' disks, when an executor is lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int):
    """crc32 of the id written as text, modulo ``n``; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer by underscores until no column has it (in any case, as Spark compares names)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int):
    """Arrow batches in parts of at most ``rows`` rows, so that few values are Python objects at a time."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(lo, rows)
