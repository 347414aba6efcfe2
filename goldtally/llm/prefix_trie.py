"""Operator 12: the trie of conversation prefixes, through minimal-perfect-hash node tables.

A node is a distinct sequence of first turns, named by a chained digest of 128
bits.  Digests of single turns are made where rows are read; only those are
sorted by conversation and chained in a stream, so that a conversation of any
length needs the memory of one digest.  Distinct digests with their members,
smallest member and ends are counted with partial aggregates.

Sums over subtrees come from shards of bounded size: pieces of at most
``BAND`` consecutive depths of a conversation, dealt by hash.  In a shard the
distinct digests get the slots of a minimal perfect hash (``SlotTable``: rounds
of bit positions that one key alone takes, then ranks), each checked against
the digest stored there; counts are scattered into flat arrays by slot, and
added up through the parent-slot array from the deepest level to the highest.
A node counts once although many shards hold it, because each node's own share
is carried by its smallest member alone, and what a conversation has below a
band enters the band at its deepest node.  The shards' sums are added by digest.

Defined cases: conversations are ordered by turn, null first, ties by role,
then text; null role or text is empty; rows without a conv_id belong to no
conversation and make no node; repeated rows are turns of their own; extra
columns are ignored; an empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Depths of a conversation that one shard takes together, and the rows of a shard.
BAND = 4096
SHARD_ROWS = 200_000
#: Digest of the textless root.
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


class SlotTable:
    """A minimal perfect hash of distinct 16-byte digests: n keys, slots 0 to n - 1.

    In each round the keys left are hashed into twice as many bits; a key that
    is alone on its bit takes it.  The slot is the rank of the bit over all
    rounds.  ``slots`` looks keys up and checks the digest stored in the slot.
    """

    def __init__(self, keys: np.ndarray):
        """``keys``: distinct, of shape (n, 2), unsigned 64-bit."""
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        left, taken = keys, 0
        while len(left):
            bits = 2 * len(left)
            at = self._positions(left, len(self.rounds), bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1 + taken
            self.rounds.append((alone, rank))
            taken += int(alone.sum())
            left = left[~alone[at]]
        self.stored = np.zeros((self.size, 2), dtype=np.uint64)
        self.stored[self._lookup(keys)] = keys

    @staticmethod
    def _positions(keys: np.ndarray, round_no: int, bits: int) -> np.ndarray:
        # digests are uniform already: mix both halves with the round's odd numbers
        first, second = np.uint64(2 * round_no + 1), np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            x = (keys[:, 0] * first) ^ (keys[:, 1] + first * second)
            x = (x ^ (x >> np.uint64(29))) * second
        return ((x ^ (x >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)

    def _lookup(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        open_keys = np.arange(len(keys))
        for k, (alone, rank) in enumerate(self.rounds):
            at = self._positions(keys[open_keys], k, len(alone))
            hit = alone[at]
            found[open_keys[hit]] = rank[at[hit]]
            open_keys = open_keys[~hit]
        return found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is not in the table."""
        found = self._lookup(keys)
        there = found >= 0
        there[there] = (self.stored[found[there]] == keys[there]).all(axis=1)
        return np.where(there, found, -1)


def subtree_sums(digest: np.ndarray, parent: np.ndarray, depth: np.ndarray, shares: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum the rows' shares over each node's subtree within a shard.

    ``digest`` and ``parent`` of shape (rows, 2), ``shares`` of shape (rows, k);
    ``heads`` marks rows whose parent lies in another band.  Returns the first
    row of each node and the node's sums.
    """
    order = np.lexsort((digest[:, 1], digest[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (digest[order][1:] != digest[order][:-1]).any(axis=1)
    distinct = order[new]
    slot_of = SlotTable(digest[distinct])
    slot = slot_of.slots(digest)
    if (slot < 0).any():
        raise RuntimeError("a digest has no slot")
    sums = np.zeros((slot_of.size, shares.shape[1]), dtype=np.int64)
    np.add.at(sums, slot, shares)
    row, above, level = (np.zeros(slot_of.size, dtype=np.int64) for _ in range(3))
    row[slot] = np.arange(len(slot))
    above[slot] = np.where(heads, -1, slot_of.slots(parent))
    level[slot] = depth
    by_depth = np.argsort(-level, kind="stable")
    cuts = np.flatnonzero(np.diff(level[by_depth])) + 1
    for nodes in np.split(by_depth, cuts):
        nodes = nodes[above[nodes] >= 0]
        np.add.at(sums, above[nodes], sums[nodes])
    return row, sums


def _shard(key, rows):
    digest, parent = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype="<u8").reshape(-1, 2) for c in ("digest", "parent"))
    depth, head = rows.column("depth").to_numpy(), rows.column("head").to_numpy(zero_copy_only=False)
    shares = np.stack([rows.column(c).to_numpy() for c in ("saved", "leaf")], axis=1)
    first, sums = subtree_sums(digest, parent, depth, shares, head)
    return pa.table({"digest": rows.column("digest").take(pa.array(first)), "saved": pa.array(sums[:, 0]), "leaves": pa.array(sums[:, 1])})


def _chained(batches):
    """Rows sorted by conversation and depth, each with its prefix digest and its parent's."""
    conv, digest = None, ROOT
    for batch in batches:
        digests, parents = [], []
        for c, turn in zip(batch.column("conv_id").to_pylist(), batch.column("turn_digest").to_pylist()):
            if turn is None:  # depth 0
                conv, digest = c, ROOT
                digests.append(ROOT)
                parents.append(None)
                continue
            if c != conv:
                raise RuntimeError("a conversation without its root row")
            parents.append(digest)
            digest = hashlib.sha256(digest + turn).digest()[:16]
            digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("depth"), batch.column("words"), batch.column("length"), pa.array(digests, pa.binary()), pa.array(parents, pa.binary())],
            names=["conv_id", "depth", "words", "length", "digest", "parent"])


def rebuilt(rows: DataFrame, borrowed: Column, base: Column) -> DataFrame:
    """Every conversation's rebuilt turns and its root row: conv_id, depth, length, turn_digest, words.

    ``borrowed`` (of conv_id) is how many first turns come from conversation ``base`` (of conv_id).
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), text.alias("text"))
    # the texts are needed for ties in turn and role only, so they do not travel unless there are some
    tied = turns.groupBy("conv_id", "turn", "role").agg(F.min("turn_digest").alias("low"), F.max("turn_digest").alias("high"))
    if tied.filter("low != high").isEmpty():
        turns = turns.drop("text")
        order = ["turn", "role"]
    else:
        order = ["turn", "role", "text"]
    turns = turns.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")).select("conv_id", "pos", "turn_digest", "words")
    turns = stored(turns, "trie-turns")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    lengths = lengths.select("conv_id", "own", borrowed.cast("long").alias("h"), base.alias("base"))
    lengths = lengths.join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own")), "base", "left")
    lengths = stored(lengths.select("conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("lent"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("kept")), "trie-lengths")
    whole = (F.col("lent") + F.col("kept")).alias("length")
    roots = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), whole, F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("words"))
    most = lengths.agg(F.max("h")).first()[0] or 0
    first = turns.filter(F.col("pos") <= most).withColumnRenamed("conv_id", "base")
    lent = lengths.filter("lent > 0").join(first, "base").filter("pos <= lent").select("conv_id", F.col("pos").alias("depth"), whole, "turn_digest", "words")
    own = turns.join(lengths, "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), whole, "turn_digest", "words")
    return roots.unionByName(lent).unionByName(own)


def _ends(batches):
    """Sorted (digest, conv_id) rows, hashed in a stream: one row for each digest."""
    now, state = None, None
    for batch in batches:
        out: list[tuple[bytes, str]] = []
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest == now:
                state.update(b",%d" % conv)
            else:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], names=["digest", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["digest", "ends"])


def trie(turns: DataFrame, band: int = BAND, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of ``turns`` (as ``rebuilt`` gives them): digest, parent and the sums of the contract."""
    laid = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    rows = stored(laid.mapInArrow(_chained, "conv_id long, depth long, words long, length long, digest binary, parent binary"), "trie-rows")
    ends = F.col("depth") == F.col("length")
    nodes = stored(rows.groupBy("digest").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.count_if(ends).alias("n_ends")), "trie-nodes")
    # a conversation is the smallest member from some depth on, down to its end
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("owns_from"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("own_leaf"))
    rows = rows.join(owners, "conv_id", "left")
    owned = F.coalesce(F.col("depth") >= F.col("owns_from"), F.lit(False))
    rows = stored(rows.select("conv_id", "depth", "length", "digest", "parent", F.when(owned, 0).otherwise(F.col("words")).cast("long").alias("saved"),
                              F.when(ends & owned, F.coalesce("own_leaf", F.lit(0))).otherwise(0).cast("long").alias("leaf"),
                              F.floor(F.col("depth") / band).cast("long").alias("band")), "trie-shares")
    # what a long conversation has in deeper bands enters each band at its deepest node
    by_band = rows.filter(F.col("length") >= band).groupBy("conv_id", "band").agg(
        F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"), F.max("depth").alias("depth"), F.max_by("digest", "depth").alias("digest"),
        F.max_by("parent", "depth").alias("parent"), F.first("length").alias("length"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    inflow = by_band.select("conv_id", "depth", "length", "digest", "parent", F.coalesce(F.sum("saved").over(deeper), F.lit(0)).alias("saved"),
                            F.coalesce(F.sum("leaf").over(deeper), F.lit(0)).alias("leaf"), "band").filter("depth < length")
    shares = rows.unionByName(inflow)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = shares.select("digest", F.coalesce("parent", F.lit(ROOT)).alias("parent"), "depth", (F.col("depth") % band == 0).alias("head"), "saved", "leaf",
                          F.pmod(F.xxhash64("conv_id", "band"), F.lit(shards)).alias("shard"))
    sums = dealt.groupBy("shard").applyInArrow(_shard, "digest binary, saved long, leaves long")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("children"))
    ended = _ended(rows)
    parents = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    facts = nodes.join(parents, "parent", "left").select("digest", "conv_id", "depth", "parent_conv_id", "n_convs")
    # one aggregate by digest brings all facts of a node together
    every = facts.unionByName(sums, allowMissingColumns=True).unionByName(children, allowMissingColumns=True).unionByName(ended, allowMissingColumns=True)
    return every.groupBy("digest").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.coalesce(F.max("children"), F.lit(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.coalesce(F.max("ends"), F.lit(NO_ENDS)).alias("ends_sha256"))


def _ended(rows: DataFrame) -> DataFrame:
    """(digest, ends): the hash of the conversations that end in a node, in order."""
    last = rows.filter("depth = length").select("digest", "conv_id")
    return last.repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_ends, "digest binary, ends string")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    h = F.crc32(conv.cast("string").cast("binary")) % 4
    turns = rebuilt(table(spark, sf_dir, "conversations"), h, conv - conv % 20)
    return trie(turns).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 % 4 needs the lowest bits only, but these depend on all; it is written out by bits.
SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS td, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT c, c - c % 20 AS b,
    xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT),
      lambda crc, x: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(crc, x)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM t),
turns AS (
  SELECT v.c, t.pos AS o, t.td, t.w FROM convs v JOIN t ON t.c = v.b AND t.pos <= v.h
  UNION ALL SELECT v.c, 10 + t.pos, t.td, t.w FROM convs v JOIN t ON t.c = v.c AND t.pos > v.h),
made AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, td, w FROM turns),
chain AS (
  SELECT c, 0::BIGINT AS d, '' AS k, NULL::VARCHAR AS p, 0::BIGINT AS w FROM convs
  UNION ALL SELECT chain.c, m.d, sha256(chain.k || m.td), chain.k, m.w FROM chain JOIN made m ON m.c = chain.c AND m.d = chain.d + 1),
node AS (SELECT k, any_value(p) AS p, any_value(d) AS d, min(c) AS c, count(*) AS n, any_value(w) AS w FROM chain GROUP BY k),
kids AS (SELECT p AS k, count(*) AS n FROM node WHERE p IS NOT NULL GROUP BY p),
ending AS (SELECT c, max(d) AS d FROM chain GROUP BY c),
ends AS (SELECT chain.k, sha256(string_agg(chain.c::VARCHAR, ',' ORDER BY chain.c)) AS h FROM chain JOIN ending e ON e.c = chain.c AND e.d = chain.d GROUP BY chain.k),
sums AS (
  SELECT a.k, sum((u.n - 1) * u.w)::BIGINT AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM node u JOIN chain a ON a.c = u.c AND a.d <= u.d LEFT JOIN kids ON kids.k = u.k GROUP BY a.k)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves,
  sums.saved AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM node JOIN sums ON sums.k = node.k LEFT JOIN node up ON up.k = node.p LEFT JOIN kids ON kids.k = node.k LEFT JOIN ends ON ends.k = node.k
"""
