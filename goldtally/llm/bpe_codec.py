"""Operator 10: BPE encoding and decoding by speculation and verification.

Every text is cut into chunks, each distinct chunk is encoded once in its
task: greedy longest match proposes tokens, one vectorised check tests all
distinct adjacent pairs, and only words with an incompatible pair are merged
exactly.  Decoding joins the token bytes.  There is no shuffle.

Defined cases: a null text counts as empty (0 tokens, hashes of nothing); rows
are kept as they are, repeated or with a null id; other columns are ignored;
an empty table gives an empty result.  A text is held whole in one task, as
its row is anyway.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytebpe import SpeculativeCodec, codec, encode_texts
from .common import table


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every text as array<int>."""

    def run(batches):
        coder = codec(SpeculativeCodec, path)
        for batch in batches:
            ids = [np.frombuffer(b, dtype="<i4") for b in encode_texts(coder, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text): the text that the ids stand for; null ids give a null text."""

    def run(batches):
        coder = codec(SpeculativeCodec, path)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.asarray(x, dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode in one pass, returning counts and hashes in place of ids and texts."""

    def run(batches):
        coder = codec(SpeculativeCodec, path)
        for batch in batches:
            count, first, second = [], [], []
            for ids in encode_texts(coder, batch.column(1).to_pylist()):
                count.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
