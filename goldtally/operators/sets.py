"""Set and count comparisons over lists given as long rows.

The in-row forms (``functions.rules.set_overlap`` / ``set_equal`` /
``count_rule``) work on list columns of one record.  When the lists are
*built* from rows -- e.g. all elements of one record spread over a big
table -- collecting them per record would put a hot record into a single
task.  The forms here never collect: elements are de-duplicated by
``(record, field, element)`` (a well-spread key), then counted per
``(record, field)`` with partial aggregation, so a record holding a third of
all rows costs one pre-aggregated row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flags(gold: DataFrame, pred: DataFrame, keys: list[str], elem: str) -> DataFrame:
    g = gold.select(*keys, F.col(elem).alias("_e"), F.lit(1).alias("_g"), F.lit(0).alias("_p"))
    p = pred.select(*keys, F.col(elem).alias("_e"), F.lit(0).alias("_g"), F.lit(1).alias("_p"))
    return (g.unionByName(p).groupBy(*keys, "_e")
            .agg(F.max("_g").alias("_g"), F.max("_p").alias("_p")))


def distinct_counts(gold: DataFrame, pred: DataFrame, keys: list[str], elem: str) -> DataFrame:
    """Per ``keys``: distinct gold elements ``g_n``, distinct predicted
    ``p_n`` and distinct common ``both_n`` (a null element counts once, like
    a member of a Python set)."""
    return (_flags(gold, pred, keys, elem).groupBy(*keys)
            .agg(F.sum("_g").cast("long").alias("g_n"), F.sum("_p").cast("long").alias("p_n"),
                 F.sum(F.col("_g") * F.col("_p")).cast("long").alias("both_n")))


def set_overlap_long(pairs: DataFrame, gold: DataFrame, pred: DataFrame, keys: list[str],
                     elem: str) -> DataFrame:
    """L1 over long rows.  ``pairs`` lists every (record, field) that gold
    declares (its lists may be empty).  Result ``keys.., m, t``: both sides
    empty -> (1, 1); else (distinct common, distinct gold)."""
    counts = distinct_counts(gold, pred, keys, elem)
    j = pairs.select(*keys).join(counts, keys, "left")
    g_n, p_n = F.coalesce(F.col("g_n"), F.lit(0)), F.coalesce(F.col("p_n"), F.lit(0))
    both_empty = (g_n == 0) & (p_n == 0)
    return j.select(*keys,
                    F.when(both_empty, F.lit(1)).otherwise(F.coalesce(F.col("both_n"), F.lit(0))).cast("long").alias("m"),
                    F.when(both_empty, F.lit(1)).otherwise(g_n).cast("long").alias("t"))


def set_equal_long(gold: DataFrame, pred: DataFrame, keys: list[str], elem: str) -> DataFrame:
    """L2 over long rows: ``keys.., g_n, p_n, equal`` for records with at
    least one element on either side (records with none on both sides are
    equal by definition and handled by the caller's join)."""
    c = distinct_counts(gold, pred, keys, elem)
    return c.withColumn("equal", (F.col("g_n") == F.col("p_n")) & (F.col("both_n") == F.col("g_n")))
