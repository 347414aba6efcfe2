"""Spark session helpers.

The library never creates a session on its own inside an operator; operators
take DataFrames.  ``local_session`` is for tests, the bench and examples.
On a cluster the user brings a session whose ``spark.checkpoint.dir`` points
at shared storage; ``checkpoint_dir`` only fills it in where it is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every session used with this library should have.  AQE re-plans
# joins at run time (broadcast when a side is small after filtering,
# skew-split of hot join keys), and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A re-run task repeats side effects of user extraction functions.
    "spark.speculation": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "goldtally", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GOLDTALLY_DRIVER_MEMORY", "8g"))
    )
    for key, value in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per session, so that functions pickled
    by reference resolve wherever the driver was started.  Spark itself hands
    the archive out; executors never open the driver's file."""
    context = spark.sparkContext
    if getattr(context, "_goldtally_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="goldtally-ship-")) / "goldtally.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._goldtally_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory.  A scratch one is set only
    where none is configured and the master is local; on a cluster executors
    would each write to a disk of their own, so an unset folder is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
    path = tempfile.mkdtemp(prefix="goldtally-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint directory for written intermediate
    tables (shared storage on a cluster)."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as two underscores) for the jobs that start inside, as they were afterwards."""
    named = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    try:
        for key, value in named.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def once(spark: SparkSession):
    """For writes that nothing repeats: the shuffle files of the job are dropped
    when it ends; without that they stay on disk until the driver happens to
    collect garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the checkpoint directory in zstd, as the frame
    that reads it (this runs a job)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with once(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
