"""A training corpus from raw documents: quality rules, toxicity, near
duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its
predecessor kept; its result is written as Parquet and read again as the next
stage's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldtally.llm import near_dedup, packing, quality_rules, secret_scan, toxicity
from goldtally.llm.common import stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged, name = quality_rules.judged(docs)
    return judged.filter(F.col(name)["kept"]).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; learnt from the labelled rows of these docs."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group of near copies (five-word shingles, 0.8) stays."""
    return near_dedup.one_of_each(docs, width=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; no document goes."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence of at most 1024 tokens and its place there."""
    import public_tokenizers

    return packing.pack(stored(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), shared=True), "pieces"))


STAGES = [("quality_rules", quality_stage), ("toxicity", toxicity_stage), ("near_dedup", dedup_stage), ("secret_scan", secrets_stage), ("packing", packing_stage)]

#: Toxicity, novelty and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
