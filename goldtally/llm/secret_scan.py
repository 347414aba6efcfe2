"""Operator 3: secrets, by patterns and by dictionary-primed zstandard novelty.

Base patterns find assignments, access keys and long hexadecimal strings.
Beside them, every string of secret characters that follows a sensitive word
closely is a candidate; its marginal compressed bytes are measured with a
zstandard dictionary made of code identifiers and of the text around it (without
the candidate itself).  A candidate that costs nearly what its alphabet allows, so cannot be
built from its surroundings, is reported as kind ``novel``, unless a base
span covers it.  Candidates are read to their end; one goes on over
lines of its length and one shorter line (a shorter line alone only from 40 characters on).
Sensitive words inside a candidate that was not reported start candidates of
their own, each up to the next such word, so each character is measured a
bounded number of times, however long a string is.  A candidate of letters or
digits alone must be long (``PLAIN``), as words and plain numbers are not.

Defined cases: a null text is empty and has no spans; rows stay as they
are, repeated or with a null id; an empty table gives an empty result; a column
named as the result of ``scan`` makes that name longer by an underscore.
Positions are code points, ends exclusive.  Whole texts are read, very long ones
in time proportional to their length.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed patterns of the base kinds, in the order of kinds.
KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Sensitive words, each by a part that every spelling of it holds, and its pattern.
_WORDS = {"passw": "passw(?:or)?d", "passphrase": "passphrase", "pwd": "pwd", "secret": "secret", "token": "token",
          "key": "(?:api|access|private)[_ -]?key", "credential": "credential", "authorization": "authorization", "bearer": "bearer", "signature": "signature"}
_HINTS = tuple(map(str.encode, _WORDS))
_SENSITIVE = re.compile(f"(?:{'|'.join(_WORDS.values())})s?(?![a-z])", re.I | re.A)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_=-]+)(?=[ \t]*(?:\r?\n|\Z))")
#: A candidate goes on over following lines of its length, as an armoured key does, and one shorter line; over this alone if it has this length.
LINE = 40
#: How far behind a sensitive word a candidate may start, and how much text around it primes the dictionary.
REACH = 48
AROUND = 2048
#: Marginal bytes for each character from which a candidate is incompressible, and the share of its
#: alphabet's entropy that is enough where that is less.
NOVELTY = 0.7
SHARE = 0.92
#: Length from which a candidate may be of letters or of digits alone.
PLAIN = 32
#: Alphabets that keys are written in, smallest first; any other candidate has all 66 characters.
_ALPHABETS = [(len(a), re.compile(f"[{c}]+")) for a, c in (
    ("0123456789abcdef", "0-9a-f"), ("0123456789ABCDEF", "0-9A-F"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "A-Z2-7="), ("abcdefghijklmnopqrstuvwxyz234567", "a-z2-7="),
    ("0123456789abcdefghijklmnopqrstuvwxyz", "0-9a-z"), ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0-9A-Z"))]
#: Identifiers that often stand in code beside secrets.
IDENTIFIERS = (
    b"abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 000000000000 xxxxxxxxxxxx "
    b"password passwd secret token api_key apikey access_key access_token client_id client_secret private_key public_key "
    b"authorization bearer basic username user_name database connection_string localhost example changeme placeholder "
    b"your_password_here your_api_key_here config settings environment variable export import return function default "
    b"production development staging testing string integer boolean undefined null none true false getenv os.environ process.env")


def novelty(text: str, start: int, end: int) -> float:
    """Marginal compressed bytes of text[start:end] for each of its bytes, given identifiers and surroundings."""
    import zstandard

    own = text[start:end].encode()
    around = text[max(0, start - AROUND):start].encode() + b"\n" + text[end:end + AROUND].encode()
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(press.compress(own)) - len(press.compress(b""))) / len(own)


def enough(body: str) -> float:
    """The novelty from which ``body`` is incompressible, by the smallest alphabet that it is written in."""
    body = "".join(re.split("[-_\\s]", body))
    size = next((size for size, pattern in _ALPHABETS if pattern.fullmatch(body)), 66)
    return min(NOVELTY, SHARE * math.log2(size) / 8)


def candidates(text: str, after: int):
    """(start, end) of whole candidates that start at most REACH behind ``after``, over all lines of a key."""
    at, stop = after, after + REACH + 12
    while m := _CANDIDATE.search(text, at, stop):
        start, at = m.start(), _CANDIDATE.match(text, m.start()).end()
        first, lines, last = at - start, 1, at - start
        while last == first and (line := _LINE.match(text, at)) and (len(line[1]) == first or len(line[1]) < first and (lines > 1 or first >= LINE)):
            lines, last, at = lines + 1, len(line[1]), line.end()
        yield start, at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    low = text.encode().lower()
    spans = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"key")):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"akia" in low:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Incompressible strings close behind a sensitive word that no base span covers."""
    low = text.encode().lower()
    if not any(k in low for k in _HINTS):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    starts = [s for s, _, _ in base]
    ends = list(itertools.accumulate((e for _, _, e in base), max))
    found, done = [], set()

    def novel(s: int, e: int) -> bool:
        before = bisect.bisect_right(starts, s)
        if before and ends[before - 1] >= e:  # base spans start in order, so one that covers it has the greatest end so far
            return False
        body = text[s:e]
        if len(body) < PLAIN and not (re.search("[0-9]", body) and re.search("[A-Za-z]", body)):
            return False
        return novelty(text, s, e) >= enough(body)

    last_end, last_novel = 0, False  # the candidate that reaches furthest
    for k, (_, after) in enumerate(words):
        if after < last_end:
            if last_novel:
                continue
            stop = min([last_end, *(s for s, _ in words[k + 1:k + 2])])
            m = _CANDIDATE.search(text, after, stop)
            spans = [m.span()] if m and m.start() <= after + REACH else []
        else:
            spans = candidates(text, after)
        for s, e in spans:
            if s in done:
                continue
            done.add(s)
            hit = novel(s, e)
            if hit:
                found.append((s, 3, e))
            if e > last_end:
                last_end, last_novel = e, hit
    return found


def all_spans(text: str) -> tuple[list, list]:
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base))


def joined(spans: list[tuple[int, int, int]], kinds=KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, name: str = "_spans") -> DataFrame:
    """Every column of ``docs`` and ``name``: the spans of its text as array of (start, end, kind)."""
    while name in docs.columns:
        name += "_"
    schema = docs.select("*", F.lit(None).cast("array<struct<start:int,end:int,kind:string>>").alias(name)).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            spans = [[{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in all_spans(t or "")[1]] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; a null text stays null, ``n_chars`` follows the text."""
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                spans, out, last = all_spans(text or "")[1], [], 0
                for s, _, e in spans:
                    if s >= last:
                        out += [text[last:s], mark]
                    last = max(last, e)
                texts.append(text if not spans else "".join(out) + text[last:])
            columns = list(batch.columns)
            if n_at is not None:
                old = batch.column(at).to_pylist()
                counts = batch.column(n_at).to_pylist()
                columns[n_at] = pa.array([len(b) if b != a else n for a, b, n in zip(old, texts, counts)], columns[n_at].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _digests(batches):
    for batch in batches:
        rows = [[], [], [], [], []]
        for text in batch.column(1).to_pylist():
            base, spans = all_spans(text or "")
            kinds = [k for _, k, _ in base]
            for column, value in zip(rows, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(),) * 3 + (pa.string(),) * 2))],
                                         names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digests, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
