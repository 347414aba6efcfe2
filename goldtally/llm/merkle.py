"""Operator 13: a Merkle manifest of a dataset, its subtrees in van Emde Boas layout.

Rows become leaf digests in DataFrame functions and are numbered inside their
run (a language) by a range sort, so a run that holds most rows is spread over
all tasks.  Aligned subtrees of at most ``2 ** BLOCK`` leaves are built one to
a group and stored as one array each in van Emde Boas order: the upper half of
the levels first, then the lower subtrees one after the other, each laid out
the same way.  ``address`` gives the place of any node by arithmetic, for
construction and for finding siblings alike.  Block roots are the leaves of
the next level of blocks, until one block is left in each run; the runs' roots
make one more tree in the same way.  Proofs go down again: each level of
blocks hands its members the siblings inside the block and those above it.

Defined cases: a null value is the mark ``-`` in its leaf, a null run comes
first, a null order value comes before others; repeated rows are a leaf each,
rows tied in order and content are numbered as stored (their leaves are
equal).  Very long texts are hashed where they are read, only digests travel.
Extra columns are ignored.  An empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldtally.operators.keys import with_record_id

from .common import stored, table

#: Height of a stored block: at most 2 ** BLOCK leaves, half a megabyte of nodes.
BLOCK = 13
#: Bytes of one step of a proof: the sibling's side and its digest.
STEP = 33
NONE, LEFT, RIGHT = 0, 1, 2


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of one depth in a stored tree of ``levels`` levels."""
    place = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            levels, depth = levels - top, depth - top
            place = place + (1 << top) - 1 + (index >> depth) * ((1 << levels) - 1)
            index = index & ((1 << depth) - 1)
    return place


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _digests(raw: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(raw), dtype=np.uint8).reshape(-1, 32)


def build(leaves: list[bytes], height: int) -> np.ndarray:
    """A block's nodes in van Emde Boas order, one row of 32 bytes each.  Missing nodes are zero."""
    nodes = np.zeros(((2 << height) - 1, 32), dtype=np.uint8)
    nodes[address(height + 1, height, np.arange(len(leaves)))] = np.frombuffer(b"".join(leaves), dtype=np.uint8).reshape(-1, 32)
    width = len(leaves)
    for depth in range(height, 0, -1):
        level = nodes[address(height + 1, depth, np.arange(width))].tobytes().hex()
        parents = [_hash(level[at:at + 128]) for at in range(0, len(level), 128)]
        width = len(parents)
        nodes[address(height + 1, depth - 1, np.arange(width))] = _digests("".join(parents))
    return nodes


def siblings(nodes: np.ndarray, height: int, width: int, slots: np.ndarray) -> np.ndarray:
    """For each leaf slot its steps inside the block, lowest first: (slots, height, STEP) bytes."""
    steps = np.zeros((len(slots), height, STEP), dtype=np.uint8)
    for k, depth in enumerate(range(height, 0, -1)):
        other = (slots >> k) ^ 1
        there = other < -(-width >> k)
        steps[there, k, 0] = np.where(other & 1, RIGHT, LEFT)[there]
        steps[there, k, 1:] = nodes[address(height + 1, depth, other[there])]
    return steps


def fold(leaf: str, path: bytes) -> str:
    """The root that a leaf's hex digest and its steps lead to."""
    for at in range(0, len(path), STEP):
        side, other = path[at], path[at + 1:at + STEP].hex()
        leaf = _hash(leaf if side == NONE else other + leaf if side == LEFT else leaf + other)
    return leaf


def proof(path: bytes) -> str:
    """H of the siblings of a path."""
    return _hash("".join(path[at + 1:at + STEP].hex() for at in range(0, len(path), STEP) if path[at] != NONE))


def leaf_digest(*columns: Column) -> Column:
    """Binary sha256 of the columns: ``-`` for null, else UTF-8 byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.unhex(F.sha2(F.concat(*parts), 256))


@dataclass
class Manifest:
    """Stored tables: leaves (run, idx, digest, the payload) and the blocks of each level; ``top`` holds the runs' roots alike."""

    leaves: DataFrame
    levels: list[DataFrame]
    runs: DataFrame
    top: list[DataFrame]
    block: int


_BLOCK_SCHEMA = "run string, block long, width int, height int, nodes binary, root binary, left int"


def _block_builder(most: int):
    def run(key, rows):
        rows = rows.sort_by("idx")
        left = rows.column("left")[0].as_py()
        height = min(most, left)
        nodes = build(rows.column("digest").to_pylist(), height)
        return pa.table({"run": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "width": pa.array([len(rows)], pa.int32()),
                         "height": pa.array([height], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()),
                         "root": pa.array([nodes[0].tobytes()], pa.binary()), "left": pa.array([left - height], pa.int32())})

    return run


def _forest(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Blocks of each level over (run, idx, digest, left); ``left`` is the height still to be built."""
    levels: list[DataFrame] = []
    while True:
        grouped = nodes.groupBy("run", F.shiftright("idx", most).alias("block"))
        blocks = stored(grouped.applyInArrow(_block_builder(most), _BLOCK_SCHEMA), "merkle-blocks")
        levels.append(blocks)
        rest = blocks.filter("left > 0")
        if rest.isEmpty():
            return levels
        nodes = rest.select("run", F.col("block").alias("idx"), F.col("root").alias("digest"), "left")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves: the bits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def manifest(rows: DataFrame, run: Column, order: Column, digest: Column, payload: dict[str, Column] | None = None, block: int = BLOCK) -> Manifest | None:
    """Build the trees of ``rows``: one for each run, ordered by ``order``, and one over the runs.  None for an empty table."""
    payload = payload or {}
    # null first, then by the bytes of the run
    named = F.coalesce(F.concat(F.lit("="), run.cast("string")), F.lit("-"))
    first = stored(rows.select(named.alias("run"), order.alias("ord"), digest.alias("digest"), F.monotonically_increasing_id().alias("tie"),
                               *[c.alias(k) for k, c in payload.items()]), "merkle-leaves")
    placed = with_record_id(first, ["run", "ord", "digest", "tie"], name="place", offset=0)
    runs = stored(placed.groupBy("run").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-runs")
    if runs.isEmpty():
        return None
    leaves = stored(placed.join(runs, "run").select("run", (F.col("place") - F.col("first")).alias("idx"), "digest", _height(F.col("n")).alias("left"), *payload),
                    "merkle-index")
    levels = _forest(leaves.select("run", "idx", "digest", "left"), block)
    roots = levels[0].filter("left = 0").select("run", "root")
    for blocks in levels[1:]:
        roots = roots.union(blocks.filter("left = 0").select("run", "root"))
    roots = with_record_id(roots, ["run"], name="idx", offset=0)
    total = F.lit(runs.count())
    top = stored(roots.select(F.lit("").alias("run"), "idx", F.col("root").alias("digest"), _height(total).alias("left"), F.col("run").alias("member")), "merkle-tops")
    return Manifest(leaves, levels, top, _forest(top.select("run", "idx", "digest", "left"), block), block)


def _with_paths(keep: list[str], most: int):
    """Cogroup members of a block with the block's nodes and the steps above it."""

    def run(key, members, block):
        got: dict = {}
        for row in block.to_pylist():
            got.update({k: v for k, v in row.items() if v is not None})
        nodes = np.frombuffer(got["nodes"], dtype=np.uint8).reshape(-1, 32)
        slots = members.column("idx").to_numpy() & ((1 << most) - 1)
        steps = siblings(nodes, got["height"], got["width"], slots)
        size, raw, n = steps.shape[1] * STEP, steps.tobytes(), len(slots)
        paths = [raw[k * size:(k + 1) * size] + got["above"] for k in range(n)]
        return pa.table([*(members.column(c) for c in keep), pa.array(paths, pa.binary()), pa.array([got.get("subroot")] * n, pa.binary()),
                         pa.array([got["root"]] * n, pa.binary())], names=[*keep, "path", "subroot", "root"])

    return run


def _down(members: DataFrame, blocks: DataFrame, above: DataFrame, keep: list[str], most: int) -> DataFrame:
    """``members`` (run, idx, kept columns) with path, subroot and root, from their blocks and what is above those."""
    right = blocks.select("run", "block", "nodes", "height", "width").unionByName(above, allowMissingColumns=True)
    left = members.select("run", "idx", *[c for c in keep if c not in ("run", "idx")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keep).schema) + ", path binary, subroot binary, root binary"
    grouped = left.groupBy("run", F.shiftright("idx", most).alias("block")).cogroup(right.groupBy("run", "block"))
    return grouped.applyInArrow(_with_paths(keep, most), schema)


def prove(made: Manifest, payload: list[str]) -> DataFrame:
    """Every leaf with its digest, payload, path (steps from its sibling up to the root), subroot and root."""
    above = made.top[-1].select("run", "block", F.lit(b"").alias("above"), F.lit(None).cast("binary").alias("subroot"), "root")
    for k in range(len(made.top) - 1, 0, -1):
        members = made.top[k - 1].select("run", F.col("block").alias("idx"))
        above = stored(_down(members, made.top[k], above, ["run", "idx"], made.block), "merkle-above").select("run", F.col("idx").alias("block"), F.col("path").alias("above"), "subroot", "root")
    runs = _down(made.runs.withColumnRenamed("digest", "own"), made.top[0], above, ["member", "own"], made.block)
    runs = stored(runs.select(F.col("member").alias("run"), F.lit(0).cast("long").alias("block"), F.col("path").alias("above"), F.col("own").alias("subroot"), "root"), "merkle-above")
    above = None
    for k in range(len(made.levels) - 1, -1, -1):
        blocks = made.levels[k]
        # runs whose last block is on this level start here
        here = blocks.filter("left = 0").select("run").join(runs, "run")
        above = here if above is None else above.unionByName(here)
        if k:
            members = made.levels[k - 1].filter("left > 0").select("run", F.col("block").alias("idx"))
            above = stored(_down(members, blocks, above, ["run", "idx"], made.block), "merkle-above").select("run", F.col("idx").alias("block"), F.col("path").alias("above"), "subroot", "root")
    return _down(made.leaves, made.levels[0], above, ["digest", *payload], made.block)


def verified(proofs: DataFrame) -> DataFrame:
    """Fold each ``claimed`` digest (null: the leaf's own) along its path; adds leaf, proof_sha256, folded_root, verified."""

    def run(batches):
        for batch in batches:
            ids, leaf, claimed, path, subroot, root = (batch.column(k).to_pylist() for k in range(6))
            folded = [fold((c or own).hex(), p) for own, c, p in zip(leaf, claimed, path)]
            roots = [r.hex() for r in root]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.hex() for x in leaf], pa.string()), pa.array([x.hex() for x in subroot], pa.string()), pa.array(roots, pa.string()),
                 pa.array([proof(p) for p in path], pa.string()), pa.array(folded, pa.string()), pa.array([a == b for a, b in zip(folded, roots)], pa.bool_())],
                names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return proofs.select("doc_id", "digest", "claimed", "path", "subroot", "root").mapInArrow(run, _VERIFIED)


_VERIFIED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    digest = leaf_digest(doc_id, source, lang, n_chars, text)
    more = n_chars.cast("decimal(20,0)") + 1
    hit = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    claimed = F.when(hit, leaf_digest(doc_id, source, lang, more, text))
    made = manifest(docs, lang, doc_id, digest, {"doc_id": doc_id, "claimed": claimed})
    if made is None:
        return spark.createDataFrame([], _VERIFIED)
    return verified(prove(made, ["doc_id", "claimed"]))


#: crc32 is written out: the bits of each byte are folded in turn.
SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 0 AS hit
  FROM documents),
leaf AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars::HUGEINT + CASE WHEN hit THEN 1 ELSE 0 END)::VARCHAR) || ':'
      || (n_chars::HUGEINT + CASE WHEN hit THEN 1 ELSE 0 END) END || tail) AS claimed FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaf),
low AS (
  SELECT lang, 0 AS depth, idx, leaf AS h FROM placed
  UNION ALL
  SELECT lang, depth + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM low) WHERE n > 1 GROUP BY lang, depth, idx // 2),
subroots AS (SELECT lang, max(depth) AS height, arg_max(h, depth) AS subroot FROM low GROUP BY lang),
high AS (
  SELECT 0 AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, subroot AS h FROM subroots
  UNION ALL
  SELECT depth + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY depth, idx // 2),
top AS (SELECT max(depth) AS height, arg_max(h, depth) AS root FROM high),
runs AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS run FROM subroots),
steps AS (
  SELECT p.lang, p.idx, d.depth, s.h, (p.idx >> d.depth) & 1 AS own FROM placed p JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang
    JOIN (SELECT unnest(range(64)) AS depth) d ON d.depth < r.height LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM p.lang AND s.depth = d.depth AND s.idx = xor(p.idx >> d.depth, 1)
  UNION ALL
  SELECT p.lang, p.idx, 100 + d.depth, s.h, (r.run >> d.depth) & 1 FROM placed p JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang
    JOIN top t ON true JOIN (SELECT unnest(range(64)) AS depth) d ON d.depth < t.height LEFT JOIN high s ON s.depth = d.depth AND s.idx = xor(r.run >> d.depth, 1)),
paths AS (
  SELECT lang, idx, coalesce(string_agg(h, '' ORDER BY depth), '') AS others,
    list(CASE WHEN h IS NULL THEN '-' WHEN own = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY depth) AS steps FROM steps GROUP BY lang, idx),
folded AS (
  SELECT p.doc_id, p.leaf, r.subroot, t.root, sha256(coalesce(q.others, '')) AS proof_sha256,
    list_reduce(coalesce(q.steps, []::VARCHAR[]), lambda acc, e: CASE e[1] WHEN 'L' THEN sha256(e[2:] || acc) WHEN 'R' THEN sha256(acc || e[2:]) ELSE sha256(acc) END, p.claimed) AS folded_root
  FROM placed p JOIN runs r ON r.lang IS NOT DISTINCT FROM p.lang JOIN top t ON true LEFT JOIN paths q ON q.lang IS NOT DISTINCT FROM p.lang AND q.idx = p.idx)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
