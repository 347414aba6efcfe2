"""Operator 8: personal data, by patterns and by a character BiLSTM-CRF.

Base patterns find e-mail addresses, IP addresses, card and phone numbers.
Their spans are the labels from which a character-level bidirectional LSTM with
CRF transitions is trained in numpy, on a bounded sample: ``SAMPLE`` windows of
``LEARN`` characters with the least hashes, half of them from the windows that
touch a base span and half from the others, repeated windows once.

Every text is cut whole into windows of ``WIDTH`` characters that overlap by
``OVERLAP``, and Viterbi decoding tags each.  Readings are reconciled over the
whole text: a character takes its tag from the window where it lies most
central, and a span is a begin tag with the inside tags that follow, over as many
windows as it needs.  Base spans stay as they are; the model adds those of its
spans that overlap none.

Defined cases: a null text is empty and has no spans; rows stay as they
are, repeated or with a null id; other columns are ignored; an empty table
gives an empty result; where no window touches a base span, the model adds no
span.  Long texts take time and memory in proportion to their length.  Base
spans of different kinds may overlap; equal starts are listed in the order of the kinds.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

KINDS = ("email", "ip", "card", "phone")
LEARN = 96
WIDTH = 256
OVERLAP = 32
SAMPLE = 2000
HIDDEN = 16
EMBED = 12
BATCH = 768  # windows scored at a time
BLOCK = 384  # windows side by side in one product of matrices
CHARS = 130  # ASCII, any other character, and the edge of the text
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# every address and card number lies in one of these, as whole as it is in the text
_DIGITS = re.compile(r"[0-9](?:[\x20.-]?[0-9])+")
# a digit before the start is impossible for a leftmost match; saying so keeps long digit runs linear
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, sorted."""
    spans, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            spans.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    for run in _DIGITS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text, *run.span()) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text, *run.span()):
            digits = re.sub("[^0-9]", "", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def codes(part: str, width: int = LEARN) -> np.ndarray:
    """Character codes, filled up to ``width`` with the code of the text's edge."""
    raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = np.full(max(width, len(raw)), CHARS - 1, dtype=np.uint8)
    out[:len(raw)] = np.minimum(raw, CHARS - 2)
    return out


def windows(text: str) -> np.ndarray:
    """Codes of all windows over the text, one row each."""
    step = WIDTH - OVERLAP
    n = 1 + max(0, -(-(len(text) - WIDTH) // step))
    return np.lib.stride_tricks.sliding_window_view(codes(text, (n - 1) * step + WIDTH), WIDTH)[::step]


def tags(start: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(LEARN, dtype=np.int64)
    for s, k, e in spans:
        a, b = max(0, s - start), min(LEARN, e - start)
        if a < b and not out[a:b].any():
            out[a:b] = 2 + 2 * k
            if s >= start:
                out[a] = 1 + 2 * k
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """Embedding, two LSTMs, a linear layer, and CRF transitions; weights are a dict of arrays."""

    def __init__(self, seed: int = 5, weights: dict | None = None):
        if weights is not None:
            self.w = weights
            return
        rng = np.random.default_rng(seed)
        self.w = {"embed": rng.normal(0, 0.3, (CHARS, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.w |= {f"x{d}": rng.normal(0, 0.25, (EMBED, 4 * HIDDEN)), f"h{d}": rng.normal(0, 0.25, (HIDDEN, 4 * HIDDEN)), f"c{d}": np.r_[np.ones(HIDDEN), np.zeros(3 * HIDDEN)]}

    def _lstm(self, x, d, keep):
        """x: (T, B, EMBED); gates in the order forget, input, output, candidate."""
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        h = c = np.zeros((x.shape[1], HIDDEN))
        out, saved = np.empty((*x.shape[:2], HIDDEN)), []
        for t in range(len(x)):
            z = pre[t] + h @ self.w[f"h{d}"]
            g = _sigmoid(z[:, :3 * HIDDEN])
            f, i, o, n = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
            old, c = c, f * c + i * n
            tc = np.tanh(c)
            if keep:
                saved.append((h, old, f, i, o, n, tc))
            h = o * tc
            out[t] = h
        return out, saved

    def _lstm_back(self, x, d, saved, grad, total):
        dh = dc = np.zeros_like(grad[0])
        dz = np.empty((*x.shape[:2], 4 * HIDDEN))
        for t in range(len(x) - 1, -1, -1):
            h, old, f, i, o, n, tc = saved[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * old * f * (1 - f), dc * n * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
            dz[t] = z
            total[f"h{d}"] += h.T @ z
            dh, dc = z @ self.w[f"h{d}"].T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        total[f"x{d}"] += x.reshape(-1, EMBED).T @ flat
        total[f"c{d}"] += flat.sum(0)
        return dz @ self.w[f"x{d}"].T

    def scores(self, batch: np.ndarray, keep: bool = False):
        """(T, B, TAGS) emission scores for (B, T) character codes."""
        x = self.w["embed"][batch.T]
        f, sf = self._lstm(x, "f", keep)
        b, sb = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return both @ self.w["out"] + self.w["bias"], (x, both, sf, sb)

    def loss_and_grad(self, batch: np.ndarray, gold: np.ndarray):
        """Negative CRF log likelihood of the gold tags, and its gradient."""
        emit, (x, both, sf, sb) = self.scores(batch, True)
        move, steps, size = self.w["move"], *emit.shape[:2]
        alpha = np.empty_like(emit)
        alpha[0] = emit[0]
        for t in range(1, steps):
            alpha[t] = emit[t] + _logsum(alpha[t - 1][:, :, None] + move, 1)
        norm = _logsum(alpha[-1], 1)
        beta, dmove = np.zeros_like(emit), np.zeros_like(move)
        for t in range(steps - 2, -1, -1):
            ahead = emit[t + 1] + beta[t + 1]
            beta[t] = _logsum(move + ahead[:, None, :], 2)
            dmove += np.exp(alpha[t][:, :, None] + move + ahead[:, None, :] - norm[:, None, None]).sum(0)
        demit = np.exp(alpha + beta - norm[None, :, None])
        g, rows = gold.T, np.arange(size)
        path = sum(emit[t, rows, g[t]].sum() for t in range(steps)) + move[g[:-1], g[1:]].sum()
        for t in range(steps):
            demit[t, rows, g[t]] -= 1
        np.subtract.at(dmove, (g[:-1], g[1:]), 1)
        total = {k: np.zeros_like(v) for k, v in self.w.items()}
        total["move"] = dmove
        flat = demit.reshape(-1, TAGS)
        total["out"], total["bias"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        dboth = demit @ self.w["out"].T
        dx = self._lstm_back(x, "f", sf, dboth[:, :, :HIDDEN], total)
        dx = dx + self._lstm_back(x[::-1], "b", sb, dboth[::-1, :, HIDDEN:], total)[::-1]
        np.add.at(total["embed"], batch.T, dx)
        return (norm.sum() - path) / size, {k: v / size for k, v in total.items()}

    def viterbi(self, batch: np.ndarray) -> np.ndarray:
        return _best_paths(self.scores(batch)[0], self.w["move"])

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.01, size: int = 32) -> float:
        """Adam over shuffled mini-batches; returns the last epoch's mean loss."""
        rng, step, losses = np.random.default_rng(11), 0, [0.0]
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order, losses = rng.permutation(len(x)), []
            for lo in range(0, len(x), size):
                loss, grad = self.loss_and_grad(x[order[lo:lo + size]], y[order[lo:lo + size]])
                losses.append(loss)
                step += 1
                norm = np.sqrt(sum((g * g).sum() for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.w[k] = self.w[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)
        return float(np.mean(losses))


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _best_paths(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(B, T) tags of the best path for (T, B, TAGS) scores."""
    steps, size = emit.shape[:2]
    best = np.ascontiguousarray(emit.transpose(0, 2, 1))
    for t in range(1, steps):
        best[t] += (best[t - 1][:, None] + move[:, :, None]).max(0)
    out = np.empty((size, steps), dtype=np.int64)
    out[:, -1] = best[-1].argmax(0)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = (best[t - 1] + move[:, out[:, t]]).argmax(0)
    return out


class Decoder:
    """The trained model in single precision, for windows of codes.

    Both directions run side by side.  A window whose best path is outside throughout is known without the
    Viterbi recursion by an exact bound: ``lift`` moves scores between a path's steps
    (they cancel along the path) so that no tag reaches "outside" better than "outside"
    itself does; if then no step gains by any other tag, the path is the best.
    """

    def __init__(self, w: dict):
        # sigmoid(x) = (1 + tanh(x / 2)) / 2, and the state holds 2 h, the embedding and a one, in this order;
        # the product has the candidate, the three gates, and what the h of the step before adds to its scores
        into = []
        for d, out, bias in zip("fb", np.split(w["out"], 2), (w["bias"], np.zeros(TAGS))):
            gates = np.vstack([w[f"h{d}"] / 2, w[f"x{d}"], w[f"c{d}"]]).T
            into.append(np.vstack([gates[3 * HIDDEN:], gates[:3 * HIDDEN] / 2, np.hstack([out.T / 2, np.zeros((TAGS, EMBED)), bias[:, None]])]))
        self.into = np.stack(into)[:, None].astype(np.float32)
        self.embed = w["embed"].astype(np.float32)
        self.move = w["move"].astype(np.float32)
        self.lift = np.minimum(0, self.move[0, 0] - self.move[:, 0])
        self.lift[0] = 0
        self.gain = (self.move + self.lift[:, None] - self.lift).max(0) - self.move[0, 0]
        self.room = np.empty(0, dtype=np.float32)

    def _emissions(self, batch: np.ndarray) -> np.ndarray:
        """(T, blocks, TAGS, block) scores, good until the next call; windows lie along the last axis, so that numpy's loops are long."""
        (size, steps), parts = batch.shape, -(-len(batch) // BLOCK)
        block = -(-size // parts)
        code = np.zeros((parts * block, steps), dtype=np.uint8)
        code[:size] = batch
        code = np.ascontiguousarray(code.reshape(parts, block, steps).transpose(2, 0, 1))
        if len(self.room) < code.size * (TAGS + EMBED):
            self.room = np.empty(code.size * (TAGS + EMBED), dtype=np.float32)
        emit = self.room[:code.size * TAGS].reshape(steps, parts, TAGS, block)
        x = self.room[code.size * TAGS:code.size * (TAGS + EMBED)].reshape(steps, parts, EMBED, block)
        for t in range(0, steps, 16):
            x[t:t + 16] = self.embed[code[t:t + 16]].transpose(0, 1, 3, 2)
        state = np.zeros((2, parts, HIDDEN + EMBED + 1, block), dtype=np.float32)
        state[:, :, -1] = 1
        h, ahead, back = state[:, :, :HIDDEN], state[0, :, HIDDEN:-1], state[1, :, HIDDEN:-1]
        # the memory cell, candidate, forget, input and output gate, scores; so cell and candidate lie as their gates do
        z, other = np.zeros((2, parts, 5 * HIDDEN + TAGS, block), dtype=np.float32), np.empty((2, parts, HIDDEN, block), dtype=np.float32)
        c, n, _, _, o = (z[:, :, g * HIDDEN:(g + 1) * HIDDEN] for g in range(5))
        product, squashed, gates = z[:, :, HIDDEN:], z[:, :, HIDDEN:5 * HIDDEN], z[:, :, 2 * HIDDEN:5 * HIDDEN]
        pair, pair_gates, half, one = z[:, :, :2 * HIDDEN], z[:, :, 2 * HIDDEN:4 * HIDDEN], np.float32(0.5), np.float32(1)
        emit[:] = 0
        for t in range(steps):
            ahead[...], back[...] = x[t], x[steps - 1 - t]
            np.matmul(self.into, state, out=product)
            if t:
                emit[t - 1] += z[0, :, 5 * HIDDEN:]
                emit[steps - t] += z[1, :, 5 * HIDDEN:]
            np.tanh(squashed, out=squashed)
            np.add(gates, one, out=gates)
            np.multiply(pair, pair_gates, out=pair)
            np.add(c, n, out=c)
            np.multiply(c, half, out=c)
            np.tanh(c, out=other)
            np.multiply(o, other, out=h)
        np.matmul(self.into, state, out=product)
        emit[-1] += z[0, :, 5 * HIDDEN:]
        emit[0] += z[1, :, 5 * HIDDEN:]
        return emit

    def _parts(self, batch: np.ndarray):
        """Bounds of about equal parts of at most ``BATCH`` windows, and their scores."""
        cuts = np.linspace(0, len(batch), 1 - (-len(batch) // BATCH)).astype(int).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield lo, hi, self._emissions(batch[lo:hi])

    def scores(self, batch: np.ndarray) -> np.ndarray:
        """(T, B, TAGS) emission scores for (B, T) codes."""
        return np.concatenate([emit.transpose(0, 1, 3, 2).reshape(len(emit), -1, TAGS)[:, :hi - lo] for lo, hi, emit in self._parts(batch)], axis=1)

    def _open(self, emit: np.ndarray) -> np.ndarray:
        """For each window (blocks, block) whether some step gains by a tag other than outside."""
        gain = self.gain[1:, None]
        found = (emit[0, :, 1:] - self.lift[1:, None] >= emit[0, :, :1]).any(1)
        for t in range(1, len(emit), 16):
            found |= ((emit[t:t + 16, :, 1:] + gain).max(2) >= emit[t:t + 16, :, 0]).any(0)
        return found

    def paths(self, batch: np.ndarray) -> np.ndarray:
        out, at, kept = np.zeros(batch.shape, dtype=np.uint8), [], []
        for lo, hi, emit in self._parts(batch):
            part, place = np.nonzero(self._open(emit))
            which = lo + part * emit.shape[3] + place
            real = which < hi
            at.append(which[real])
            kept.append(emit[:, part[real], :, place[real]].transpose(1, 0, 2))
            if hi == len(batch) or sum(map(len, at)) >= BATCH:
                which = np.concatenate(at)
                if len(which):
                    out[which] = _best_paths(np.concatenate(kept, axis=1), self.move)
                at, kept = [], []
        return out


def _learnable(text: str):
    """Base spans, and for each window to learn from whether it touches one."""
    spans = base_spans(text)
    touched = np.zeros(1 + max(0, -(-(len(text) - LEARN) // (LEARN // 2))), dtype=bool)
    for s, _, e in spans:
        touched[max(0, (s - LEARN) // (LEARN // 2) + 1):(e - 1) // (LEARN // 2) + 1] = True
    return spans, touched


def _count(batches):
    for batch in slices(batches, 256):
        n = np.zeros(2, dtype=np.int64)
        for text in batch.column(0).to_pylist():
            if text:
                n += np.bincount(_learnable(text)[1], minlength=2)
        yield pa.RecordBatch.from_arrays([pa.array(n[:1]), pa.array(n[1:])], names=["clean", "touched"])


def _least(bounds: tuple[int, int]):
    """The windows of both sorts whose crc32 is under the sort's bound, as codes and tags."""

    def run(batches):
        for batch in slices(batches, 256):
            rows = []
            for text in batch.column(0).to_pylist():
                if text:
                    spans, touched = _learnable(text)
                    raw = codes(text).tobytes()
                    for k, sort in enumerate(touched.tolist()):
                        start = k * (LEARN // 2)
                        x = raw[start:start + LEARN]
                        if zlib.crc32(x) < bounds[sort]:
                            rows.append((sort, x.ljust(LEARN, bytes([CHARS - 1])), tags(start, spans).astype(np.uint8).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.bool_(), pa.binary(), pa.binary()))], names=["touched", "x", "y"])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Weights learnt from ``sample`` windows, half of them with base spans; None where there is no span.

    Windows are counted first, so that tasks together send little more than the sample."""
    text = docs.select("text")
    n = text.mapInArrow(_count, "clean long, touched long").agg(F.sum("clean"), F.sum("touched")).first()
    if not n[1]:
        return None
    bounds = tuple(min(2 ** 32, int(2 ** 32 * (sample / 2 + 4 * sample ** 0.5) / max(1, k or 0))) for k in n)
    rows = text.mapInArrow(_least(bounds), "touched boolean, x binary, y binary").groupBy("touched", "x").agg(F.min("y").alias("y")).collect()
    rows = sorted(((r.touched, zlib.crc32(bytes(r.x)), bytes(r.x), bytes(r.y)) for r in rows))
    rows = [r for sort in (False, True) for r in [r for r in rows if r[0] == sort][:sample // 2]]
    x, y = (np.frombuffer(b"".join(r[k] for r in rows), dtype=np.uint8).reshape(-1, LEARN).astype(np.int64) for k in (2, 3))
    model = BiLstmCrf()
    model.fit(x, y)
    return model.w


def reconciled(paths: np.ndarray, length: int) -> np.ndarray:
    """A text's tags from its windows' paths: each character's from the window where it lies most central."""
    edge, step = OVERLAP // 2, WIDTH - OVERLAP
    return np.concatenate([paths[0, :edge], paths[:, edge:edge + step].ravel(), paths[-1, edge + step:]])[:length]


def tag_spans(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of each begin tag with the inside tags that follow it."""
    before = np.r_[0, path[:-1]]
    goes_on = (path > 0) & (path % 2 == 0) & ((before == path) | (before + 1 == path))
    starts, stops = np.flatnonzero(path % 2 == 1), np.r_[np.flatnonzero(~goes_on), len(path)]
    ends = stops[np.searchsorted(stops, starts, "right")]
    return list(zip(starts.tolist(), ((path[starts].astype(np.int64) - 1) // 2).tolist(), ends.tolist()))


def with_base(base: list[tuple[int, int, int]], own: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Base spans and those of the model's that overlap none of them."""
    if not own:
        return base
    edges = np.zeros(length + 1, dtype=np.int64)
    for s, _, e in base:
        edges[s] += 1
        edges[e] -= 1
    covered = np.r_[0, np.cumsum(np.cumsum(edges) > 0)]
    return sorted(base + [(s, k, e) for s, k, e in own if covered[s] == covered[e]])


def tagged(texts: list[str], model: Decoder | None):
    """For each text its base spans and all spans."""
    for lo in range(0, len(texts), 128):
        part = texts[lo:lo + 128]
        cut = [windows(t) if model and t else None for t in part]
        flat, at = [w for w in cut if w is not None], 0
        if flat:
            paths = model.paths(np.concatenate(flat))
        for text, w in zip(part, cut):
            base, own = base_spans(text), []
            if w is not None:
                mine = paths[at:at + len(w)]
                if mine.any():
                    own = tag_spans(reconciled(mine, len(text)))
                at += len(w)
            yield base, with_base(base, own, len(text))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, weights: dict | None) -> DataFrame:
    """doc_id, counts of base kinds, base digest and all spans of every row."""

    def run(batches):
        model = Decoder(weights) if weights else None
        for batch in slices(batches, 256):
            rows = [[], [], [], [], [], []]
            for base, spans in tagged([t or "" for t in batch.column(1).to_pylist()], model):
                kinds = [k for _, k, _ in base]
                for column, value in zip(rows, (*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(),) * 4 + (pa.string(),) * 2))],
                                             names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op8_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))
