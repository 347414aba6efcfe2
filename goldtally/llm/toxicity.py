"""Operator 5: toxicity by a bidirectional GRU with attention pooling.

A word's input joins a learnt vector (words of the training sample), its
smoothed log odds between toxic and clean training documents, and the mean of
learnt vectors of its hashed character trigrams, so unseen spellings have an
input too.  Overlapping windows of ``WIDTH`` words, ``STEP`` apart, cover every
text; both GRUs run over a window, attention pools their states, and a logistic
layer scores it.  A document scores as its highest window.

Training (numpy, Adam) takes ``SAMPLE`` toxic and as many clean documents at
most, those with the least hashes of their ids.  A toxic document teaches through
its highest window, a clean one through its highest and one other, chosen anew
after each round.

Defined cases: a null or empty text is a window without words; a null id
counts as held out (its remainder is 0); rows without a label or with a null one are
scored, not learnt from; repeated rows are scored each; labels repeated for one id
count as toxic if any says so; other columns are kept out of scores; with no
label of either kind every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, free_name, table

WIDTH = 48
STEP = 24
SAMPLE = 1500
HIDDEN = 8
WORD = 6
CHAR = 8
INPUT = WORD + 1 + CHAR
BUCKETS = 4096
#: Words of the training sample that have a vector of their own, and in how many of its documents they must stand.
VOCABULARY = 20_000
LEAST_DOCS = 3
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character trigram of all words (with borders), and each word's first position."""
    raw = ("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass")
    c = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    first = np.cumsum(length) - length
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    bucket = ((h ^ (h >> np.uint64(15))) % np.uint64(BUCKETS)).astype(np.int64)
    inside = np.ones(len(c), dtype=bool)
    inside[first + length - 1] = inside[first + length - 2] = False
    return bucket[inside[:-2]], np.cumsum(length - 2) - (length - 2)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """Weights ``w`` (arrays) and the words that have vectors; row 0 of the word table is for all others."""

    def __init__(self, vocabulary: dict[str, int], odds: np.ndarray, weights: dict | None = None, seed: int = 3):
        self.vocabulary, self.odds = vocabulary, odds
        if weights is not None:
            self.w = weights
            return
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.w = {"word": rng.normal(0, 0.1, (len(odds), WORD)), "char": rng.normal(0, 0.3, (BUCKETS, CHAR)), "query": rng.normal(0, 0.3, 2 * h),
                  "attend": rng.normal(0, 0.3, (2 * h, 2 * h)), "out": rng.normal(0, 0.3, 2 * h), "bias": np.array(-1.0)}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.3, (INPUT, 3 * h)), f"h{d}": rng.normal(0, 0.3, (h, 3 * h)), f"c{d}": np.zeros(3 * h)}
        self.w["word"][0] = 0
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def inputs(self, words: list[str]):
        """Inputs of distinct words, and what training needs to reach their parts."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        bucket, first = trigrams(words)
        count = np.diff(np.r_[first, len(bucket)]).astype(np.float32)
        chars = np.add.reduceat(self.w["char"][bucket], first) / count[:, None] if len(words) else np.zeros((0, CHAR), np.float32)
        x = np.concatenate([self.w["word"][ids], self.odds[ids][:, None], chars], axis=1).astype(np.float32)
        return x, (ids, bucket, first, count)

    def _gru(self, pre, d, mask, saved=None):
        """pre: (T, B, 3H) input parts of the gates reset, update, candidate; mask: (T, B, 1)."""
        h, u = np.zeros((pre.shape[1], HIDDEN), dtype=np.float32), self.w[f"h{d}"]
        out = np.empty((*pre.shape[:2], HIDDEN), dtype=np.float32)
        for t in range(len(pre)):
            z = h @ u
            g = _sigmoid(pre[t, :, :2 * HIDDEN] + z[:, :2 * HIDDEN])
            r, k = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(pre[t, :, 2 * HIDDEN:] + r * z[:, 2 * HIDDEN:])
            m = mask[t]
            if saved is not None:
                saved.append((h, r, k, n, z[:, 2 * HIDDEN:], m))
            h = h + m * (1 - k) * (n - h)
            out[t] = h
        return out

    def _gru_back(self, d, saved, grad, total):
        dh, dpre = np.zeros_like(grad[0]), np.empty((*grad.shape[:2], 3 * HIDDEN), dtype=np.float32)
        for t in range(len(grad) - 1, -1, -1):
            h, r, k, n, zn, m = saved[t]
            dh = dh + grad[t]
            dn = dh * m * (1 - k) * (1 - n * n)
            dk = -dh * m * (n - h) * k * (1 - k)
            dr = dn * zn * r * (1 - r)
            dpre[t] = np.concatenate([dr, dk, dn], axis=1)
            dz = np.concatenate([dr, dk, dn * r], axis=1)
            total[f"h{d}"] += h.T @ dz
            dh = dh * (1 - m * (1 - k)) + dz @ self.w[f"h{d}"].T
        return dpre

    def window_scores(self, gates: dict, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ``index`` (B, T) are rows of the gate tables, ``mask`` says which are words."""
        m = mask.T[:, :, None].astype(np.float32)
        sf, sb = ([], []) if keep else (None, None)
        f = self._gru(gates["f"][index.T], "f", m, sf)
        b = self._gru(gates["b"][index.T[::-1]], "b", m[::-1], sb)[::-1]
        both = np.concatenate([f, b], axis=2)
        hidden = np.tanh(both @ self.w["attend"])
        weight = hidden @ self.w["query"] + np.where(m[:, :, 0] > 0, 0, -1e9)
        weight = np.exp(weight - weight.max(0))
        weight = weight * m[:, :, 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        return pooled @ self.w["out"] + self.w["bias"], (m, sf, sb, both, hidden, weight, pooled)

    def gates(self, x):
        return {d: x @ self.w[f"x{d}"] + self.w[f"c{d}"] for d in "fb"}

    def grad(self, words: list[str], index: np.ndarray, mask: np.ndarray, y: np.ndarray):
        x, (ids, bucket, first, count) = self.inputs(words)
        logit, (m, sf, sb, both, hidden, weight, pooled) = self.window_scores(self.gates(x), index, mask, True)
        p = _sigmoid(logit)
        d = (p - y) / len(y)
        total = {k: np.zeros_like(v) for k, v in self.w.items()}
        total["out"], total["bias"] = pooled.T @ d, d.sum()
        dpooled = d[:, None] * self.w["out"]
        dboth = weight[:, :, None] * dpooled
        dweight = np.einsum("bh,tbh->tb", dpooled, both)
        ds = weight * (dweight - (weight * dweight).sum(0))
        total["query"] = np.einsum("tb,tbh->h", ds, hidden)
        dh = ds[:, :, None] * self.w["query"] * (1 - hidden * hidden)
        total["attend"] = both.reshape(-1, 2 * HIDDEN).T @ dh.reshape(-1, 2 * HIDDEN)
        dboth = (dboth + dh @ self.w["attend"].T).astype(np.float32)
        dx = np.zeros_like(x)
        for k, saved, grad, at in (("f", sf, dboth[:, :, :HIDDEN], index.T), ("b", sb, dboth[::-1, :, HIDDEN:], index.T[::-1])):
            dpre = self._gru_back(k, saved, grad, total).reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(x), 3 * HIDDEN), dtype=np.float32)
            np.add.at(per_word, at.ravel(), dpre)
            total[f"x{k}"] += x.T @ per_word
            total[f"c{k}"] += per_word.sum(0)
            dx += per_word @ self.w[f"x{k}"].T
        np.add.at(total["word"], ids, dx[:, :WORD])
        total["word"][0] = 0
        np.add.at(total["char"], bucket, np.repeat(dx[:, WORD + 1:] / count[:, None], count.astype(np.int64), axis=0))
        return -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)), total


class Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def cut(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts of so many words: (text, first word); the last window of a text ends with it."""
    number = np.maximum(1, -(-np.maximum(counts - WIDTH, 0) // STEP) + 1)
    text = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    return text, np.minimum(k * STEP, np.maximum(0, counts[text] - WIDTH))


def _windows(texts: list[np.ndarray]):
    """(owner, index, mask) of all windows over texts given as word numbers; number 0 fills up."""
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    owner, start = cut(counts)
    flat = np.concatenate([*texts, np.zeros(WIDTH, dtype=np.int64)])
    base = np.cumsum(counts) - counts
    at = (base[owner] + start)[:, None] + np.arange(WIDTH)
    mask = (start[:, None] + np.arange(WIDTH)) < counts[owner][:, None]
    return owner, np.where(mask, flat[np.minimum(at, len(flat) - 1)], 0), mask


def score_texts(model: BiGru, texts: list[str | None]) -> np.ndarray:
    """The highest window's probability for each text."""
    numbers = Numbers()
    numbers[" "]  # fills windows up
    texts = [np.fromiter(map(numbers.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in map(words_of, texts)]
    x, _ = model.inputs(list(numbers))
    gates = model.gates(x)
    best = np.full(len(texts), -np.inf, dtype=np.float64)
    owner, index, mask = _windows(texts)
    for lo in range(0, len(owner), 2048):
        logit, _ = model.window_scores(gates, index[lo:lo + 2048], mask[lo:lo + 2048])
        np.maximum.at(best, owner[lo:lo + 2048], logit)
    return _sigmoid(best)


def fit(texts: list[str], labels: list[int], rounds: int = 3, epochs: int = 2, size: int = 64, rate: float = 0.01) -> BiGru | None:
    """Train on documents; None unless both labels are there."""
    y = np.array(labels, dtype=np.float32)
    if not (y > 0).any() or not (y == 0).any():
        return None
    split = [words_of(t) for t in texts]
    seen: dict[str, list[int]] = {}
    for ws, label in zip(split, labels):
        for w in set(ws):
            seen.setdefault(w, [0, 0])[label] += 1
    common = sorted((w for w, c in seen.items() if sum(c) >= LEAST_DOCS), key=lambda w: (-sum(seen[w]), w))[:VOCABULARY]
    vocabulary = {w: k + 1 for k, w in enumerate(common)}
    n1, n0 = (y > 0).sum(), (y == 0).sum()
    odds = np.array([0.0, *(np.log((seen[w][1] + 1) / (n1 + 2)) - np.log((seen[w][0] + 1) / (n0 + 2)) for w in common)], dtype=np.float32)
    model = BiGru(vocabulary, np.clip(odds, -3, 5))
    numbers = Numbers()
    numbers[" "]
    docs = [np.fromiter(map(numbers.__getitem__, ws), dtype=np.int64, count=len(ws)) for ws in split]
    names = list(numbers)
    owner, index, mask = _windows(docs)
    ranks = np.array([model.odds[vocabulary.get(w, 0)] for w in names])
    score = np.where(mask, ranks[index], -9).max(1) + 1e-3 * np.where(mask, ranks[index], 0).sum(1)
    rng, step = np.random.default_rng(17), 0
    mean, square = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    for r in range(rounds):
        if r:
            gates = model.gates(model.inputs(names)[0])
            score = np.concatenate([model.window_scores(gates, index[lo:lo + 2048], mask[lo:lo + 2048])[0] for lo in range(0, len(owner), 2048)])
        order = np.lexsort((-score, owner))
        highest = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        other = np.arange(len(owner))[np.lexsort((rng.random(len(owner)), owner))]
        other = other[np.r_[True, owner[other][1:] != owner[other][:-1]]]
        chosen = np.concatenate([highest, other[y[owner[other]] == 0]])
        for _ in range(epochs):
            rng.shuffle(chosen)
            for lo in range(0, len(chosen), size):
                part = chosen[lo:lo + size]
                used, back = np.unique(index[part], return_inverse=True)
                _, grad = model.grad([names[k] for k in used.tolist()], back.reshape(index[part].shape), mask[part], y[owner[part]])
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    model.w[k] = (model.w[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BiGru | None:
    """Fit on at most ``sample`` documents of each label whose crc32(doc_id) mod 5 is not 0."""
    known = (labels.select("doc_id", "toxic").filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod("doc_id", 5) != 0))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    here = docs.select("doc_id").join(known, "doc_id").distinct()
    chosen = [here.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.toxic) for r in rows])


def scored(docs: DataFrame, model: BiGru | None, column: str = "score") -> DataFrame:
    """``docs`` with a double column of scores; where ``docs`` has a column of that name, the new one's is longer by underscores."""
    column = free_name(column, docs.columns)
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def run(batches):
        for batch in batches:
            held, lo, chars = [], 0, 0
            texts = batch.column(at).to_pylist()
            for k, text in enumerate([*texts, None]):
                chars += len(text or "")
                if k == len(texts) or chars > 4_000_000:
                    held.append(score_texts(model, texts[lo:k + 1]) if model and texts[lo:k + 1] else np.zeros(len(texts[lo:k + 1])))
                    lo, chars = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(held), pa.float64())], names=[*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
