"""Files that hold one JSON array of objects, read by many tasks.

A JSON parser cannot start in the middle of an array: it does not know whether
it stands inside a string, nor how deep.  Both follow from the text before, as
a state and a sum, and these compose: each block of a file gives a map from the
state that it starts in to the state that it ends in and the change of depth.
So blocks are scanned in parallel for their maps, the maps of a file's blocks
are chained in order (one small row for each block), and blocks are scanned
again, each from its known start, to cut out the objects.

Spark splits the files at closing braces (the text source with ``}`` as line
separator), so that an object ends where a row ends.  Objects that lie in
several blocks leave a fragment in each, joined by file and block afterwards.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most blocks whose start states are handed to every task: some 100 MB there.
MOST_BLOCKS = 1_000_000
OUT, IN = 0, 1
#: What may stand before an object: a byte order mark, white space, the array's bracket, a comma.
LEAD = "\ufeff \t\r\n[,"
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)


def step(text: str, state: int) -> tuple[int, int]:
    """The state behind ``text`` and a closing brace, and the change of depth, from ``state`` before it."""
    if state == IN:
        end = _STRING_END.match(text)
        if end is None:
            return IN, 0
        text = text[end.end():]
    plain = _STRING.sub("", text)
    quote = plain.find('"')
    if quote >= 0:
        plain, state = plain[:quote], IN
    else:
        state = OUT
    change = plain.count("{") + plain.count("[") - plain.count("]")
    return state, change - (state == OUT)


def _summaries(batches):
    """(file, block, end and change for each start state) of each block."""
    now, ends, changes = None, None, None
    for batch in batches:
        out = []
        for file, block, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != now:
                if now is not None:
                    out.append((*now, *ends, *changes))
                now, ends, changes = (file, block), [OUT, IN], [0, 0]
            for start in (OUT, IN):
                ends[start], change = step(text, ends[start])
                changes[start] += change
        yield _table(out)
    if now is not None:
        yield _table([(*now, *ends, *changes)])


def _table(rows):
    types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["file", "block", "end_out", "end_in", "change_out", "change_in"])


def _chain(key, rows):
    """The state and depth that each block of one file starts in."""
    rows = rows.sort_by("block")
    state, depth, starts = OUT, 0, []
    for row in rows.to_pylist():
        starts.append((state, depth))
        depth += row["change_in" if state == IN else "change_out"]
        state = row["end_in" if state == IN else "end_out"]
    return pa.table({"file": rows.column("file"), "block": rows.column("block"), "state": pa.array([s for s, _ in starts], pa.int32()), "depth": pa.array([d for _, d in starts], pa.int64())})


def _cutter(starts):
    """Objects and fragments of each block.  ``first``: the text starts an object; ``last``: it ends one."""

    def run(batches):
        now, state, depth, held, first, place = None, OUT, 0, [], False, 0

        def flush(out):
            if now is not None and held and (depth >= 2 or state == IN):
                out.append((*now, place, "".join(held), first, False))

        for batch in batches:
            out = []
            for file, block, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != now:
                    flush(out)
                    now, held, place = (file, block), [], 0
                    state, depth = starts[now]
                    first = depth <= 1 and state == OUT
                before, (state, change) = depth, step(text, state)
                depth += change
                held.append(text + "}")
                if state == OUT and depth == 1:
                    whole = "".join(held)
                    if first:
                        whole = whole.lstrip(LEAD)
                        if not whole.startswith("{"):
                            raise ValueError(f"{file}: the elements of the array must be objects, found {whole[:40]!r}")
                    out.append((*now, place, whole, first, True))
                    held, first, place = [], True, place + 1
                elif state == OUT and depth < 1 and before <= 1:
                    held = []  # the array's end (or an empty one)
            yield _cut(out)
        out = []
        flush(out)
        yield _cut(out)

    return run


def _cut(rows):
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["file", "block", "place", "text", "first", "last"])


def array_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, place, text) of every object of the arrays in ``path``, in the order of the files by those columns.

    This runs a job for the blocks' states.  An array that is cut off gives its whole objects and an error where the rest is parsed.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = rows.mapInArrow(_summaries, "file string, block long, end_out int, end_in int, change_out long, change_in long")
    starts = blocks.groupBy("file").applyInArrow(_chain, "file string, block long, state int, depth long")
    known = {(r["file"], r["block"]): (r["state"], r["depth"]) for r in starts.limit(MOST_BLOCKS + 1).toLocalIterator()}
    if len(known) > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks: raise spark.sql.files.maxPartitionBytes")
    cut = rows.mapInArrow(_cutter(known), "file string, block long, place long, text string, first boolean, last boolean")
    whole = cut.filter("first AND last").select("file", "block", "place", "text")
    # an object over several blocks: its first fragment's block names it
    so_far = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.max(F.when(F.col("first"), F.struct("block", "place"))).over(so_far)
    parts = cut.filter("NOT (first AND last)").withColumn("start", start)
    joined = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "place", "text"))).alias("parts"))
    text = F.ltrim(F.array_join(F.transform("parts", lambda x: x["text"]), ""), F.lit(LEAD))
    return whole.unionByName(joined.select("file", F.col("start.block").alias("block"), F.col("start.place").alias("place"), text.alias("text")))


def scan_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType | str, position: str | None = None) -> DataFrame:
    """The records of JSON array files, each file read by as many tasks as it has blocks.

    ``position`` adds the object's place as ``STRUCT<file, block, place>``, as ``read_ndjson`` does."""
    objects = array_objects(spark, path)
    parsed = objects.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("_record"), F.struct("file", "block", "place").alias("_place"))
    return parsed.select("_record.*", *([F.col("_place").alias(position)] if position else []))
