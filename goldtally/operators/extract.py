"""Structured extraction as a distributed batch job.

``extract_structured`` runs a user function over a text column with
``mapInArrow``: Arrow batches reach each Python worker, which calls the
function for the rows of the batch on a small thread pool (bounded
concurrency per task, X2; the cluster-wide bound is tasks x threads, set by
the partition count).  Failed rows become error rows with their key (X3) or
fail the task (X4); retries and fallbacks are parameters (X5, X6).

Spark may run a task twice (retry after a lost executor), so results must be
keyed and written before they are scored; ``operators.keys.last_wins``
resolves any duplicate.  Keep speculation off for jobs with side effects.
"""

from __future__ import annotations

import inspect
import math
import threading
import time
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Retry:
    """Constant delay (``multiplier`` 1) or exponential back-off."""
    max_retries: int = 0
    delay_ms: float = 0.0
    multiplier: float = 1.0
    max_delay_ms: float | None = None

    def delays(self):
        d = self.delay_ms
        for _ in range(self.max_retries):
            yield min(d, self.max_delay_ms) if self.max_delay_ms is not None else d
            d *= self.multiplier


CONSTANT = Retry(max_retries=3, delay_ms=200)
EXPONENTIAL = Retry(max_retries=2, delay_ms=300, multiplier=1.5, max_delay_ms=10_000)


def _takes_attempt(fn) -> bool:
    """Whether ``attempt`` is a parameter of ``fn`` (a local variable of that name is not)."""
    try:
        return "attempt" in inspect.signature(fn).parameters
    except (TypeError, ValueError):  # built-in functions without a signature
        return False


def _call_with_retry(fn, text, retry: Retry, sleep):
    """A function with a parameter ``attempt`` is told the number of this attempt, from 0."""
    delays = list(retry.delays())
    numbered = _takes_attempt(fn)
    for attempt in range(len(delays) + 1):
        try:
            return fn(text, attempt=attempt) if numbered else fn(text)
        except Exception:  # noqa: BLE001
            if attempt == len(delays):
                raise
            sleep(delays[attempt] / 1000.0)


def _slot(key, count: int) -> int:
    """Round-robin place of a key: whole numbers by their remainder, others by a hash of their text, null first."""
    if key is None or key != key:
        return 0
    if isinstance(key, (int, float)) and math.isfinite(key):
        return int(key) % count
    return zlib.crc32(str(key).encode()) % count


def _run_one(fns, key, text, strategy, retry, sleep, delay_s):
    if delay_s:
        sleep(delay_s)
    if strategy == "round_robin":
        order = [_slot(key, len(fns))]
    else:
        order = list(range(len(fns)))
    last = None
    for i in order:
        try:
            got = _call_with_retry(fns[i], text, retry, sleep)
            if not isinstance(got, dict):
                raise TypeError(f"extraction returned {type(got).__name__}, not a dict")
            return got, None, i
        except Exception as e:  # noqa: BLE001
            last = e
    return None, f"{type(last).__name__}: {last}", None


class _Flight:
    """Calls in flight in one task, and the most there were."""

    def __init__(self):
        self.lock, self.now, self.peak = threading.Lock(), 0, 0

    def __enter__(self):
        with self.lock:
            self.now += 1
            self.peak = max(self.peak, self.now)

    def __exit__(self, *exc):
        with self.lock:
            self.now -= 1


_FLIGHT = "_gt_in_flight"
CALL_ROWS = 200     # texts, calls and results held as Python objects at a time, whatever Arrow's batch size


def _slices(batches, rows: int = CALL_ROWS):
    """The same rows in record batches of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def extract_structured(df: DataFrame, text_col: str, key: str, schema: T.StructType, fns,
                       concurrency: int = 20, delay_s: float = 0.0, on_error: str = "record",
                       retry: Retry = Retry(), strategy: str = "fallback",
                       sleep=time.sleep, observe: Observation | None = None) -> DataFrame:
    """``key, result STRUCT<schema>, error STRING, fn_index INT``.

    ``fns``: one function or a list ``text -> dict`` (fallback order, or
    round-robin by key, so a rerun picks the same one).

    ``observe`` (X2) collects, when the result is first run, ``n_rows``,
    ``n_errors`` and ``peak_in_task``, the most calls that one task had in
    flight; the cluster never has more than tasks at a time x ``peak_in_task``."""
    fns = list(fns) if isinstance(fns, (list, tuple)) else [fns]
    out_schema = T.StructType([df.schema[key], T.StructField("result", schema),
                               T.StructField("error", T.StringType()), T.StructField("fn_index", T.IntegerType())])
    if observe is not None:
        out_schema = T.StructType(out_schema.fields + [T.StructField(_FLIGHT, T.IntegerType())])
    field_names = [f.name for f in schema.fields]
    names = out_schema.names

    def run(batches):
        flight = _Flight()

        def call(keyed):
            with flight:
                return _run_one(fns, keyed[0], keyed[1], strategy, retry, sleep, delay_s)

        with ThreadPoolExecutor(max_workers=max(1, concurrency)) as pool:
            for batch in _slices(batches):
                # the key column itself is handed on, so no key changes on its way through Python
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                outs = list(pool.map(call, zip(keys, texts)))
                results, errors, used = [], [], []
                for k, (res, err, idx) in zip(keys, outs):
                    if err is None:
                        try:
                            res = {f: res.get(f) for f in field_names}
                            pa.array([res], type=result_type)
                        except (pa.ArrowException, TypeError, ValueError, OverflowError) as e:
                            res, err, idx = None, f"{type(e).__name__}: {e}", None
                    if err is not None and on_error == "raise":
                        raise RuntimeError(f"extraction failed for {key}={k}: {err}")     # X4
                    results.append(res)
                    errors.append(err)
                    used.append(idx)
                peaks = pa.array([flight.peak] * len(keys), type=pa.int32())
                columns = [batch.column(0), pa.array(results, type=result_type), pa.array(errors, type=pa.string()), pa.array(used, type=pa.int32()), peaks]
                yield pa.RecordBatch.from_arrays(columns[:len(names)], names=names)

    result_type = to_arrow_schema(T.StructType([T.StructField("result", schema)])).field(0).type
    out = df.select(key, text_col).mapInArrow(run, out_schema)
    if observe is None:
        return out
    return out.observe(observe, F.count(F.lit(1)).alias("n_rows"), F.count("error").alias("n_errors"),
                       F.max(_FLIGHT).alias("peak_in_task")).drop(_FLIGHT)


def prompt_text(text: Column, instructions: str, output_format: str) -> Column:
    """The prompt of one record: instructions, output format, the text."""
    return F.concat_ws("\n\n", F.lit(instructions), F.lit(output_format), text)


# Lexical forms of PII classes that have one (patterns valid
# for both Java regex and RE2, no look-around).
PII_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "IPV4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "IPV6": r"[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}",
    "CREDITCARDNUMBER": r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}",
    "PHONENUMBER": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "SSN": r"[0-9]{3}[-.][0-9]{2,4}[-.][0-9]{4}",
    "IBAN": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "MAC": r"[0-9A-Fa-f]{2}(:[0-9A-Fa-f]{2}){5}",
    "URL": r"https?://[^\s]+",
    "BITCOINADDRESS": r"[13][a-km-zA-HJ-NP-Z1-9]{25,34}",
    "LITECOINADDRESS": r"[LM][a-km-zA-HJ-NP-Z1-9]{26,33}",
    "ETHEREUMADDRESS": r"0x[a-fA-F0-9]{40}",
}


def pattern_hits(text: Column, classes: dict[str, str] | None = None) -> list[Column]:
    """All hits per class (``array<string>``), whole text scanned."""
    classes = classes or PII_PATTERNS
    return [F.regexp_extract_all(text, F.lit(p), 0).alias(name) for name, p in classes.items()]


def pattern_fields(text: Column, classes: dict[str, str] | None = None) -> list[Column]:
    """X12 as an extraction result: the first hit per class is the field."""
    classes = classes or PII_PATTERNS
    return [F.get(F.regexp_extract_all(text, F.lit(p), 0), 0).alias(name) for name, p in classes.items()]
