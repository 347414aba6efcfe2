"""Gold/prediction matching (J1, J2) with key hygiene (K5, K6).

Both sides are nested into one struct each (``g`` and ``p``) so that rules
address ``g.field`` / ``p.field`` without name clashes; Catalyst still prunes
the struct fields no rule reads down to the Parquet ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import KEY, drop_keyless, last_wins


def prepare_predictions(pred: DataFrame, key: str = KEY, seq: str | None = "seq") -> DataFrame:
    """K6 then K5: drop keyless rows, keep the last copy of each key by ``seq``
    (a number, or the position that ``read_ndjson`` adds).  ``seq=None`` says
    that predictions are unique per key already; a named column that is
    missing is an error, as repeated keys would multiply rows."""
    pred = drop_keyless(pred, key)
    if seq is None:
        return pred
    if seq not in pred.columns:
        raise ValueError(f"predictions have no column {seq!r} to tell the last copy of a key; pass None if keys are unique")
    return last_wins(pred, key, seq).drop(seq)


def match_records(gold: DataFrame, pred: DataFrame, key: str = KEY,
                  gold_seq: str | None = "seq", pred_seq: str | None = "seq") -> DataFrame:
    """Inner equi-join on the key.  Gold keeps duplicates; the prediction
    side is one row per key; unmatched gold is left out of scoring.

    Output: ``key, seq, g STRUCT<gold...>, p STRUCT<pred...>``.  The join is
    left to AQE (broadcast when the prediction side turns out small,
    sort-merge with skew splitting otherwise)."""
    pred = prepare_predictions(pred, key, pred_seq)
    g_cols = [c for c in gold.columns if c not in (key, gold_seq)]
    p_cols = [c for c in pred.columns if c != key]
    g_seq = F.col(gold_seq) if gold_seq and gold_seq in gold.columns else F.col(key)
    g = gold.select(F.col(key), g_seq.alias("seq"),
                    F.struct(*[F.col(c) for c in g_cols]).alias("g"))
    p = pred.select(F.col(key), F.struct(*[F.col(c) for c in p_cols]).alias("p"))
    return g.join(p, key, "inner")


def coverage(gold: DataFrame, pred: DataFrame, key: str = KEY,
             pred_seq: str | None = "seq") -> DataFrame:
    """One row ``matched, missing, unknown, keyless``.

    matched = gold rows with a prediction (J1's row count), missing = gold
    rows without one, unknown = prediction keys absent from gold, keyless =
    prediction rows without a key.  One full outer join and one aggregate
    instead of an inner and two anti joins: each side is shuffled once.
    Keyless rows bypass the join (null keys would all hash to one task) and
    are appended to its output before the single aggregate."""
    p = prepare_predictions(pred, key, pred_seq).select(key, F.lit(1).alias("_gt_p"))
    g = gold.select(key, F.lit(True).alias("_gt_g"))
    joined = g.join(p, key, "full_outer").select("_gt_g", "_gt_p")
    keyless = pred.where(F.col(key).isNull()).select(
        F.lit(None).cast("boolean").alias("_gt_g"), F.lit(0).alias("_gt_p"))
    both = joined.unionByName(keyless)
    has_g, p_flag = F.col("_gt_g").isNotNull(), F.col("_gt_p")
    return both.agg(
        F.count(F.when(has_g & (p_flag == 1), 1)).alias("matched"),
        F.count(F.when(has_g & p_flag.isNull(), 1)).alias("missing"),
        F.count(F.when(~has_g & (p_flag == 1), 1)).alias("unknown"),
        F.count(F.when(p_flag == 0, 1)).alias("keyless"))
