"""Incremental scoring of a prediction stream against static gold.

Predictions arrive as a stream (file, Kafka, ...); each micro-batch is
joined to the static gold on the key (stream-static join, gold read once
per batch with its scan pushed down), compared with the task's plan, and
its per-record outcomes are appended to an outcome table under the
session's checkpoint folder.  Last-wins (K5) across the whole stream is
resolved when the scorecard is read: the newest outcome per key wins by
``batch_id`` (inside a batch, by ``seq``).  Restarts are exactly-once through the query's own
checkpoint: a batch that is replayed writes to the same ``batch_id``
partition, overwritten as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, score
from ..operators.keys import last_wins


def start_scoring(pred_stream: DataFrame, gold: DataFrame, build_checks, outcome_path: str,
                  checkpoint_path: str, key: str = "record_id", trigger: dict | None = None, pred_seq: str | None = "seq"):
    """Start the stream; ``build_checks(matched) -> list[Check]``."""

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        matched = match.match_records(gold, batch, key=key, gold_seq=None, pred_seq=pred_seq)
        checks = build_checks(matched)
        # within a batch K5 already kept the newest copy (match_records)
        out = score.outcomes(matched, checks, key=key).withColumn("batch_id", F.lit(batch_id))
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(outcome_path))

    writer = pred_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def current_scorecard(spark: SparkSession, outcome_path: str, checks_template, key: str = "record_id") -> DataFrame:
    """Scorecard over the newest outcome of every key seen so far.
    ``checks_template`` gives field names and kinds in outcome-column order."""
    out = spark.read.parquet(outcome_path)
    newest = last_wins(out, key=key, seq="batch_id")
    return score.scorecard(newest, checks_template)
