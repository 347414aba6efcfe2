import os
import tempfile

from pyspark.sql import functions as F

from goldtally.plans.comparison import exact_checks
from goldtally.operators import match
from goldtally.streaming import scoring


def test_stream_last_wins(spark):
    base = tempfile.mkdtemp(prefix="gt-stream-")
    gold = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "record_id long, f1 string, f2 string")
    src = os.path.join(base, "in")
    spark.createDataFrame([(1, 0, "a", "WRONG"), (2, 0, "b", "y")], "record_id long, seq int, f1 string, f2 string") \
        .write.parquet(os.path.join(src, "b1"))
    schema = "record_id long, seq int, f1 string, f2 string"
    q = scoring.start_scoring(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), gold,
                              exact_checks, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    # a later correction of record 1 arrives in a second batch
    spark.createDataFrame([(1, 1, "a", "x")], schema).write.parquet(os.path.join(src, "b2"))
    q = scoring.start_scoring(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), gold,
                              exact_checks, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    template = exact_checks(match.match_records(gold, spark.createDataFrame([], schema), gold_seq=None))
    card = {r["field"]: (r["matches"], r["total"])
            for r in scoring.current_scorecard(spark, os.path.join(base, "out"), template).collect()}
    assert card == {"f1": (2, 2), "f2": (2, 2)}
