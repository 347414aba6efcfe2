"""Operator 4: token counts by counting each distinct pre-token once.

1. Each task cuts its texts at white space and at the last punctuation mark
   of a word (borders that no token crosses) and numbers the distinct
   pre-tokens of a block of documents, bucket by bucket of their checksum.  It
   writes per document the (number, frequency) pairs, and per block and bucket
   one row with the distinct pre-tokens there.
2. The buckets are shuffled by themselves; in each, the tokenizers library
   counts every distinct pre-token once, and a row of counts goes back to
   every block.  A pre-token comes at most once per block, however frequent it
   is, so no key is hot; a task holds the distinct pre-tokens of one bucket at
   a time, and there are at least as many buckets as shuffle partitions.
3. Blocks meet their counts (a co-group by block, of bounded size), and each
   document's frequencies times counts are summed.  No token id is kept.

Defined cases: a null text is empty (0 bytes, 0 tokens); rows stay as they
are, repeated or with a null id; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import stored, table

OVER = 2048
#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Buckets of pre-tokens at the least; no fewer than the session's shuffle partitions.
BUCKETS = 1024

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_PRE = re.compile(f"[{_LATIN}]+(?=[.,;:!?]?(?:[\\t-\\r ]|\\Z))|[.,;:!?](?=[\\t-\\r ]|\\Z)|[^\\t-\\r ]+")

_TABLE = "block long, doc_id long, n_bytes long, freqs binary, bucket int, words binary"


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, byte plane by byte plane, compressed."""
    import zstandard

    return zstandard.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unplaned(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0].astype(np.int64)


def packed(lids: np.ndarray, freqs: np.ndarray) -> bytes:
    """Sorted numbers as steps, then their frequencies."""
    return planes(np.concatenate([np.diff(lids, prepend=0), freqs]))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, freqs = unplaned(data).reshape(2, -1)
    return np.cumsum(steps), freqs


class Numbers(dict):
    """A number for each key, in the order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pretokens(text: str):
    """The text's pre-tokens; in Latin texts letters count alike in either case, as the tokenizer lowers them.

    Where "<|" stands the case is left alone: a special string is one only as it is spelt.
    """
    if "<|" not in text and (text.isascii() or max(text) <= "\xff"):
        text = text.lower()
    return _PRE.findall(text) if len(text) < 1 << 20 else (m.group() for m in _PRE.finditer(text))


def _block(block, docs, numbers, buckets):
    """The rows of one block: its documents, and its distinct pre-tokens renumbered by bucket."""
    import zstandard

    words = list(numbers)
    bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), dtype="<i4", count=len(words))
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(words), dtype="<i4")
    number[order] = np.arange(len(words))
    freqs = []
    for _, _, lids, counts in docs:
        lids = number[lids]
        by = np.argsort(lids)
        freqs.append(packed(lids[by], counts[by]))
    present, starts = np.unique(bucket[order], return_index=True)
    lists = [zstandard.compress("\n".join(words[i] for i in run).encode(), 3) for run in np.split(order, starts[1:])] if words else []
    n, m = len(docs), len(lists)
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * (n + m), pa.int64()), pa.array([*(d[0] for d in docs), *[None] * m], pa.int64()),
         pa.array([*(d[1] for d in docs), *[None] * m], pa.int64()), pa.array([*freqs, *[None] * m], pa.binary()),
         pa.array([*[None] * n, *present.tolist()], pa.int32()), pa.array([*[None] * n, *lists], pa.binary())],
        names=["block", "doc_id", "n_bytes", "freqs", "bucket", "words"])


def _blocks(buckets: int):
    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        numbers, docs, chars = Numbers(), [], 0
        for batch in batches:
            for doc, text in (row for k in range(0, batch.num_rows, 64) for row in zip(*(c.to_pylist() for c in batch.slice(k, 64).columns))):
                text = text or ""
                lids = np.fromiter(map(numbers.__getitem__, pretokens(text)), dtype="<i4")
                lids, freqs = np.unique(lids, return_counts=True)
                docs.append((doc, len(text.encode()), lids, freqs.astype("<u4")))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield _block((task << 24) + seq, docs, numbers, buckets)
                    seq, numbers, docs, chars = seq + 1, Numbers(), [], 0
        if docs:
            yield _block((task << 24) + seq, docs, numbers, buckets)

    return run


def _count_buckets(path: str):
    """Rows come sorted by bucket; every distinct pre-token of a bucket is encoded once."""

    def run(batches):
        import zstandard
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        at, known = None, {}
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                lists = [zstandard.decompress(data).decode().split("\n") for data in part.column(2).to_pylist()]
                counts = []
                for bucket, rows in groupby(zip(part.column(1).to_pylist(), lists), key=lambda row: row[0]):
                    if bucket != at:
                        at, known = bucket, {}
                    rows = [words for _, words in rows]
                    new = list(dict.fromkeys(w for words in rows for w in words if w not in known))
                    known.update(zip(new, (len(e.ids) for e in tokenizer.encode_batch(new, add_special_tokens=False))))
                    counts += [planes(np.fromiter(map(known.__getitem__, words), dtype="<u4", count=len(words))) for words in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.binary())], names=["block", "bucket", "counts"])

    return run


def _sum_block(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """The block's counts, bucket after bucket, are numbered as its pre-tokens are."""
    lists = counts.sort_by("bucket").column("counts").to_pylist()
    per_lid = np.concatenate([np.zeros(0, dtype=np.int64), *map(unplaned, lists)])
    totals = []
    for data in docs.column("freqs").to_pylist():
        lids, freqs = unpacked(data)
        totals.append(int(per_lid[lids] @ freqs))
    return pa.table([docs.column("doc_id"), docs.column("n_bytes"), pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row."""
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(docs.selectExpr("doc_id", "text").mapInArrow(_blocks(buckets), _TABLE), "pretokens")
    words = blocks.filter("bucket is not null").select("block", "bucket", "words")
    counted = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_buckets(path), "block long, bucket int, counts binary")
    freqs = blocks.filter("bucket is null").select("block", "doc_id", "n_bytes", "freqs")
    return (freqs.groupBy("block").cogroup(counted.groupBy("block"))
            .applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {OVER} as over_limit")
