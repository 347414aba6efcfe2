"""Operator 1: scoring texts with a hidden Markov language model.

Tokens are lower-cased words and one end token.  The model's states emit word
classes, a bounded alphabet: the ``TOP`` most frequent training words are
classes of their own, all others fall into ``TAILS`` classes by their last
three bytes; the end token is the last class.  Within its class a word has its
add-one share of the class's training tokens.  So the state and class tables have a
fixed size, while word counts, one row for each distinct word, stay in the cluster.

1. Each task numbers the distinct words of a block of documents and writes the
   documents as numbers and the block's words with their training counts.
2. Words are counted over all blocks (a word has one row per block at
   most, so none is hot), and each block gets its words' counts and classes back.
3. Baum-Welch: in each of ``ROUNDS`` rounds every task runs scaled
   forward and backward passes over all its training sequences, cut into
   ``SEGMENT`` tokens, and its expected counts are summed over partitions.
4. The scaled forward recursion over each whole text, uncut, gives its exact
   likelihood: score = log10 P(classes) + sum of log10 P(word | class).

Defined cases: null and empty texts are the end token alone; a null id
counts as training (its remainder is 0); repeated rows are separate texts;
other columns are ignored; an empty table gives an empty result; with no
training text the model is uniform over classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

STATES = 6
ROUNDS = 5
TOP = 2000
TAILS = 1000
SEGMENT = 256
BLOCK_CHARS = 32_000_000
BATCH_TOKENS = 1_000_000
END = TOP + TAILS
CLASSES = END + 1


class Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _blocks(batches):
    """Documents as word numbers, then the block's words with their training counts."""
    task, seq = TaskContext.get().partitionId(), 0

    def flush(docs, numbers):
        n, m = len(docs), len(numbers)
        counts = np.zeros(m, dtype=np.int64)
        for _, held, ids in docs:
            if not held:
                np.add.at(counts, ids, 1) if len(ids) < m // 8 else np.add(counts, np.bincount(ids, minlength=m), out=counts)
        none_m, none_n = [None] * m, [None] * n
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 24) + seq] * (n + m), pa.int64()), pa.array([*(d[0] for d in docs), *none_m], pa.int64()),
             pa.array([*(d[1] for d in docs), *none_m], pa.bool_()), pa.array([*(d[2].tobytes() for d in docs), *none_m], pa.binary()),
             pa.array([*none_n, *range(m)], pa.int32()), pa.array([*none_n, *numbers], pa.binary()), pa.array([*none_n, *counts.tolist()], pa.int64())],
            names=["block", "doc_id", "held_out", "ids", "lid", "word", "n_train"])

    numbers, docs, chars = Numbers(), [], 0
    for batch in batches:
        for doc, text, held in zip(*(c.to_pylist() for c in batch.columns)):
            words = (text or "").encode().lower().split()
            docs.append((doc, held, np.fromiter(map(numbers.__getitem__, words), dtype="<i4", count=len(words))))
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                yield flush(docs, numbers)
                seq, numbers, docs, chars = seq + 1, Numbers(), [], 0
    if docs:
        yield flush(docs, numbers)


def _classify(share_base: np.ndarray):
    """Put counts and classes of words back into a block's documents."""

    def run(docs, words):
        lid = words.column("lid").to_numpy()
        cls, c = np.zeros(len(lid), dtype="<u2"), np.zeros(len(lid), dtype=np.int64)
        cls[lid] = words.column("class").to_numpy()
        c[lid] = words.column("c").to_numpy()
        log_c = np.log10(c + 1.0)
        share = np.where(cls < TOP, 0.0, log_c - share_base[cls]) if len(cls) else log_c
        out = [[], [], [], []]
        for ids in docs.column("ids").to_pylist():
            ids = np.frombuffer(ids, dtype="<i4")
            out[0].append(int((c[ids] > 0).sum()))
            out[1].append(float(log_c[ids].sum()))
            out[2].append(float(share[ids].sum()))
            out[3].append(np.append(cls[ids], np.uint16(END)).astype("<u2").tobytes())
        return pa.table([docs.column("doc_id"), docs.column("held_out"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.binary())],
                        names=["doc_id", "held_out", "known", "log_counts", "shares", "classes"])

    return run


class Hmm:
    """start (S), move (S, S) and emit (S, classes); every row sums to 1."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, class_share: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = class_share * np.exp(rng.normal(0, 0.7, (states, len(class_share))))
        move = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(1, keepdims=True))

    def log10_likelihood(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scaled forward recursion over many sequences in step; exact for each."""
        order = np.argsort(-lengths, kind="stable")
        s, n = starts[order], lengths[order]
        total = np.zeros(len(n))
        alive = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
        a = None
        for t, k in enumerate(alive.tolist()):
            e = self.emit[:, flat[s[:k] + t]]
            a = (self.start[:, None] if t == 0 else self.move.T @ a[:, :k]) * e
            scale = a.sum(0)
            a = a / scale
            total[:k] += np.log10(scale)
        out = np.empty(len(n))
        out[order] = total
        return out

    def expected_counts(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Baum-Welch: expected starts, moves and emissions, and the log10 likelihood."""
        order = np.argsort(-lengths, kind="stable")
        s, n = starts[order], lengths[order]
        alive = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right").tolist()
        move, emit, first = (x.astype(np.float32) for x in (self.move, self.emit, self.start))
        forward, emitted, scales, log = [], [], [], 0.0
        for t, k in enumerate(alive):
            e = np.take(emit, flat[s[:k] + t], axis=1)
            a = (first[:, None] if t == 0 else move.T @ forward[-1][:, :k]) * e
            scale = a.sum(0)
            a /= scale
            log += float(np.log10(scale, dtype=np.float64).sum())
            forward.append(a)
            emitted.append(e)
            scales.append(scale)
        moves = np.zeros(self.move.shape)
        back, states, seen = None, [], []
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            b = np.ones((len(move), k), dtype=np.float32)
            if back is not None:
                j = back.shape[1]
                moves += forward[t][:, :j].astype(np.float64) @ back.T
                b[:, :j] = move @ back
            states.append(forward[t] * b)
            seen.append(flat[s[:k] + t])
            back = emitted[t] * b / scales[t]
        cls = np.concatenate(seen)
        gamma = np.concatenate(states, axis=1)
        counts = np.stack([np.bincount(cls, g, self.emit.shape[1]) for g in gamma])
        return states[-1].sum(1), moves * self.move, counts, log


def _sequences(batch_column, most: int | None):
    """(flat, starts, lengths) of sequences in parts of about BATCH_TOKENS; ``most`` cuts them into segments."""
    held, tokens = [], 0
    for raw in batch_column:
        held.append(np.frombuffer(raw, dtype="<u2"))
        tokens += len(held[-1])
        if most and tokens >= BATCH_TOKENS:
            yield _ragged(held, most)
            held, tokens = [], 0
    if held:
        yield _ragged(held, most)


def _ragged(held, most):
    lengths = np.array([len(x) for x in held])
    starts = np.cumsum(lengths) - lengths
    if most:
        parts = -(-lengths // most)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, lengths = np.repeat(starts, parts) + k * most, np.minimum(most, np.repeat(lengths, parts) - k * most)
    return np.concatenate(held).astype(np.int64), starts, lengths


def _count_task(model: Hmm):
    """One task's expected counts as rows (k, v) of a flat vector."""

    def run(batches):
        total = None
        for batch in batches:
            for flat, starts, lengths in _sequences(batch.column(0).to_pylist(), SEGMENT):
                first, moves, counts, log = model.expected_counts(flat, starts, lengths)
                vector = np.concatenate([first, moves.ravel(), counts.ravel(), [log]])
                total = vector if total is None else total + vector
        if total is not None:
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(total[k], pa.float64())], names=["k", "v"])

    return run


def train(sequences: DataFrame, class_share: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over a table of class sequences (binary column ``classes``)."""
    model = Hmm.first(class_share, states)
    size = states + states * states + states * len(class_share) + 1
    for _ in range(rounds):
        rows = sequences.select("classes").mapInArrow(_count_task(model), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(size)
        total[[r.k for r in rows]] = [r.v for r in rows]
        first, moves, counts = np.split(total[:-1], [states, states + states * states])
        start, move, emit = first + 0.1, moves.reshape(states, states) + 0.1, counts.reshape(states, -1) + 20 * class_share
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
    return model


def _score_task(model: Hmm):
    def run(batches):
        for batch in batches:
            for flat, starts, lengths in _sequences(batch.column("classes").to_pylist(), None):
                log = model.log10_likelihood(flat, starts, lengths)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lengths, pa.int64()), batch.column("known"), batch.column("log_counts"),
                                                  pa.array(log + batch.column("shares").to_numpy(), pa.float64())], names=["doc_id", "held_out", "n_tokens", "known", "log_counts", "score"])

    return run


def lm_scores(docs: DataFrame, held_out=None) -> DataFrame:
    """Base and model scores of every row; ``held_out`` says which rows are not learnt from."""
    held_out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)  # null: learnt from
    blocks = stored(docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(
        _blocks, "block long, doc_id long, held_out boolean, ids binary, lid int, word binary, n_train long"), "blocks")
    same = Window.partitionBy("word")
    counted = stored(blocks.filter("word is not null").select("block", "lid", "word", F.sum("n_train").over(same).alias("c"),
                                                              (F.row_number().over(same.orderBy("block", "lid")) == 1).alias("first")), "counts")
    distinct = counted.filter("first and c > 0")
    top = [r.word for r in distinct.orderBy(F.desc("c"), "word").limit(TOP).select("word").collect()]
    spark = docs.sparkSession
    ranked = spark.createDataFrame([(bytes(w), i) for i, w in enumerate(top)], "word binary, rank int")  # TOP rows at most
    tail = TOP + F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(TAILS))
    classed = counted.join(F.broadcast(ranked), "word", "left").withColumn("class", F.coalesce(F.col("rank").cast("long"), tail).cast("int"))
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classed.filter("first and c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # CLASSES rows at most
        tokens[r["class"]], kinds[r["class"]] = r.n, r.v
    n_docs = blocks.filter("word is null and not held_out").count()
    tokens[END], kinds[END] = n_docs, 1 if n_docs else 0
    total, distinct_tokens = int(tokens.sum()), int(kinds.sum())
    share_base = np.log10(tokens + kinds + 1)
    schema = "doc_id long, held_out boolean, known long, log_counts double, shares double, classes binary"
    sequences = stored(blocks.filter("word is null").select("block", "doc_id", "held_out", "ids").groupBy("block")
                       .cogroup(classed.select("block", "lid", "class", "c").groupBy("block")).applyInArrow(_classify(share_base), schema), "sequences")
    share = (tokens + 1) / (tokens + 1).sum()
    model = train(sequences.filter("not held_out"), share)
    scored = sequences.mapInArrow(_score_task(model), "doc_id long, held_out boolean, n_tokens long, known long, log_counts double, score double")
    end_known = 1 if n_docs else 0
    base = F.col("log_counts") + float(np.log10(n_docs + 1)) - F.col("n_tokens") * float(np.log10(total + distinct_tokens + 1))
    return scored.select("doc_id", "held_out", "n_tokens", (F.col("known") + end_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
