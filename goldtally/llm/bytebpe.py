"""Byte-level BPE over chunks of text, shared by operators 6 and 10.

The pre-tokenizer never joins characters over the border between a non-space
character and the white space that follows it, so a text may be cut there and
every distinct chunk encoded once.  ``chunks`` makes that cut; the two codecs
turn distinct chunks into ids and keep a bounded memory of what they have
encoded (a cache of a pure function: results never depend on it).
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np

#: The tokenizer's white space, as its pattern's \s has it.
SPACE = "\t-\r \u0085   -     　"
# a run of Latin letters ends at these marks in any case; possessive, as a shorter run is no border
_CHUNK = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[.,;:!?])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Most chunks that a worker remembers between batches, and where workers are shared with other stages.
MEMO = 1_500_000
SHARED_MEMO = 150_000


def chunks(text: str, specials: tuple[str, ...]) -> list[str]:
    """Cut a text where token borders are certain; a special string is a chunk of its own."""
    for special in specials:
        if special in text:
            parts = re.split("(" + "|".join(map(re.escape, specials)) + ")", text)
            return [c for p in parts for c in ([p] if p in specials else _CHUNK.findall(p))]
    return _CHUNK.findall(text)


class LibraryCodec:
    """Ids of chunks by the tokenizers library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = _specials(path)
        self.memo: dict[str, bytes] = {}

    def learn(self, missing: list[str]) -> None:
        """Many chunks go to the library as one text, a special string between
        each two: it cuts there before anything else, so chunks are encoded
        alone, and its id shows where each one ends."""
        mark = self.specials[0]
        mark_id = self.tokenizer.token_to_id(mark)
        plain = [c for c in missing if c not in self.specials]
        for lo in range(0, len(plain), 1_000):
            part = plain[lo:lo + 1_000]
            ids = np.array(self.tokenizer.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), 4 * np.flatnonzero(ids == mark_id)
            starts = [0, *(ends + 4).tolist()]
            self.memo.update(zip(part, map(raw.__getitem__, map(slice, starts, [*ends.tolist(), len(raw)])), strict=True))
        for special in set(missing).intersection(self.specials):
            self.memo[special] = np.array([self.tokenizer.token_to_id(special)], dtype="<u4").tobytes()


class SpeculativeCodec:
    """Ids by greedy longest match, kept where every adjacent pair is compatible.

    A pair of tokens is compatible if merging by rank over their joined bytes
    would end with just these two.  A word whose pairs are all compatible is
    encoded rightly by its proposal; only the others are merged step by step.
    """

    def __init__(self, path: str):
        import regex

        import public_tokenizers

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        self.specials = _specials(path)
        self.special_ids = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.fine = regex.compile(public_tokenizers.PATTERN)
        letters = _byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = data["model"]["vocab"]
        self.pieces = [b""] * (max([*vocab.values(), *self.special_ids.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special_ids:
                self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special_ids.items():
            self.pieces[i] = token.encode()
        self.byte_id = [vocab[letters[b]] for b in range(256)]
        n = len(self.pieces)
        # rank and halves of the merge that makes a token; -1 for single bytes
        self.rank, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault((i, j), r)
            self.made.append(k)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        keys = np.array([i * n + j for i, j in self.pair_rank], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], np.array(list(self.pair_rank.values()), dtype=np.int64)[order]
        # tokens that greedy matching may propose: bytes, and what some merge makes
        self.token = {self.pieces[i]: i for i in {*self.byte_id, *self.made}}
        self.longest: dict[bytes, int] = {}
        for piece in self.token:
            start = piece[:2]
            self.longest[start] = max(self.longest.get(start, 1), len(piece))
        self.memo: dict[str, bytes] = {}
        self.merged_words = 0
        self.words = 0

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For arrays of adjacent tokens: would merging leave each pair as it is?

        Merging is replayed backwards along the border: the piece left of it
        and the piece right of it, each with the rank at which its own token
        consumes it.  A merge over the border that comes before both is a clash.
        At equal rank the leftmost merge comes first.
        """
        n = len(self.pieces)
        a, b = first.astype(np.int64), second.astype(np.int64)
        never = len(self.made) + 1
        end_a, end_b = np.full(len(a), never), np.full(len(a), never)
        good, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            clash = (self.keys[at] == key) & (self.key_rank[at] < end_a[live]) & (self.key_rank[at] <= end_b[live])
            good[live[clash]] = False
            ra, rb = self.rank[x], self.rank[y]
            undo_a = (ra > rb) & ~clash
            undo_b = (rb >= ra) & (rb >= 0) & ~clash
            i = live[undo_a]
            end_a[i], a[i] = ra[undo_a], self.right[x[undo_a]]
            i = live[undo_b]
            end_b[i], b[i] = rb[undo_b], self.left[y[undo_b]]
            live = live[undo_a | undo_b]
        return good

    def propose(self, word: bytes) -> list[int]:
        token, longest, out, at, n = self.token, self.longest, [], 0, len(word)
        while at < n:
            stop = min(n, at + longest.get(word[at:at + 2], 1))
            while stop > at + 1 and word[at:stop] not in token:
                stop -= 1
            out.append(token[word[at:stop]])
            at = stop
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the merge of least rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pair_rank
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i, pair = heapq.heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (ids[i], ids[k]) in rank:
                    heapq.heappush(heap, (rank[ids[i], ids[k]], i, (ids[i], ids[k])))
            h = before[i]
            if h >= 0 and (ids[h], ids[i]) in rank:
                heapq.heappush(heap, (rank[ids[h], ids[i]], h, (ids[h], ids[i])))
        return [i for i in ids if i >= 0]

    def learn(self, missing: list[str]) -> None:
        words: dict[bytes, int] = {}
        cuts = []
        for chunk in missing:
            if chunk in self.special_ids:
                cuts.append(None)
            else:
                cuts.append([words.setdefault(w.encode(), len(words)) for w in self.fine.findall(chunk)])
        tokens = [self.propose(w) for w in words]
        length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter((i for t in tokens for i in t), dtype=np.int64, count=int(length.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(tokens)), length)
            inside = owner[1:] == owner[:-1]
            pairs, back = np.unique(flat[:-1][inside] * len(self.pieces) + flat[1:][inside], return_inverse=True)
            good = self.compatible(pairs // len(self.pieces), pairs % len(self.pieces))[back]
            failing = np.unique(owner[1:][inside][~good])
            texts = list(words)
            for i in failing.tolist():
                tokens[i] = self.merge(texts[i])
            self.merged_words += len(failing)
        self.words += len(tokens)
        packed = [np.array(t, dtype="<u4").tobytes() for t in tokens]
        for chunk, cut in zip(missing, cuts):
            self.memo[chunk] = (np.array([self.special_ids[chunk]], dtype="<u4").tobytes() if cut is None
                                else b"".join([packed[i] for i in cut]))

    def decode(self, ids: bytes) -> str:
        """Token bytes joined, as text; byte sequences that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict = {}


def codec(kind, path: str):
    """The worker's codec of this kind and vocabulary file."""
    if (kind, path) not in _CODECS:
        _CODECS[kind, path] = kind(path)
    return _CODECS[kind, path]


def encode_texts(coder, texts, batch_chars: int = 4_000_000, memo: int = MEMO):
    """Yield the ids of each text as little-endian 32-bit bytes; a null text is empty."""
    held, chars = [], 0

    def flush():
        if len(coder.memo) > memo:
            coder.memo.clear()
        known = coder.memo
        missing: set[str] = set()
        for cut in held:
            missing.update(set(cut).difference(known))
        coder.learn(list(missing))
        for cut in held:
            yield b"".join(map(known.__getitem__, cut))

    for text in texts:
        held.append(chunks(text or "", coder.specials))
        chars += len(text or "")
        if chars >= batch_chars:
            yield from flush()
            held, chars = [], 0
    yield from flush()


def _specials(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as file:
        return tuple(t["content"] for t in json.load(file)["added_tokens"])


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
