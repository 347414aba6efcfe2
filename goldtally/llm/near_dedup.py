"""Operator 7: near duplicates by a chosen-path set similarity join.

1. Each text becomes the set of its word shingles, hashed to 64 bits, with a
   signature of ``COORDS`` minwise values.  Texts with equal sets form one
   class; only classes go on, so exact copies never meet each other.
2. ``TREES`` independent trees branch the classes: a node picks one or two
   coordinates (1.25 on average, one over the threshold) by its own hash, and
   every class goes to the child named by its minwise value there.  Nodes of
   over ``LEAF`` classes branch on; smaller ones are compared exhaustively, by
   sketches of one byte for each coordinate.  At their first level the trees
   branch on 13 coordinates in all, so a pair at the threshold meets in no
   node with a probability of 0.2 ** 13.
   A large child with ``STUCK`` of its parent's members or more, as tight copies
   of one template make it, does not branch on.  Its members are confirmed against a few
   representatives by their full sets; then it is cut into blocks, of one
   component where that is large, and each pair of blocks is a node of its own, except
   pairs of blocks of one component, where no link can join anything new.
3. Of a node's pairs that agree on ``SKETCH_MIN`` or more coordinates (a pair at
   the threshold falls below that with a probability of about 2e-4), the node
   puts forward a maximum spanning forest: fewer pairs than members.  They are confirmed by
   the exact intersection of the full sets, and give components.
4. Any other such pair of the node is joined by a path of the forest whose
   pairs agree at least as well.  Only where a pair on it was refused can the
   pair matter; so trees of the forest with a refused pair whose ends are still in
   different components get their members' full sets, and intersect these
   exactly across components, by an inverted list in the task.  Such a tree puts forward one
   link for a member and another component at most.  Large groups of near
   copies so stay linear in rows, and no link between components is lost.

Defined cases: null and empty texts, and texts without words, have an empty
set and link with nothing; a text with fewer words than a shingle is one
shingle; a null id takes part in its class but names it only if all ids
there are null; repeated rows are copies; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .components import components

COORDS = 64
TREES = 10
LEAF = 4096
LEVELS = 40
#: Share of a parent's members from which a child is not branched: below it, 1.25 children of each member are no more rows than before.
STUCK = 0.75
#: Representatives of a crowded node that its members are confirmed against.
STARS = 3
SKETCH_MIN = 40
#: Rows that a task turns into Python objects at a time.
SLICE = 512

_RNG = np.random.default_rng(20_240_607)
_MULT = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, COORDS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches):
    """The batches in parts of few rows, so that few texts or sets are Python objects at a time."""
    for batch in batches:
        for lo in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(lo, SLICE)


def shingle_sets(texts: list, width: int):
    """(flat, starts): all texts' sorted distinct shingle hashes, one after the other."""
    import xxhash

    known: dict[bytes, int] = {}
    hashes, sizes = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if 0 < len(h) < width:
            acc = np.array([len(h)], dtype=np.uint64)
            for x in h:
                acc = mix(acc * _MIX + x)
            h = acc
        elif len(h):
            acc = np.zeros(len(h) - width + 1, dtype=np.uint64)
            for k in range(width):
                acc = mix(acc * _MIX + h[k:len(h) - width + 1 + k])
            h = np.unique(acc)
        hashes.append(h)
        sizes.append(len(h))
    return hashes, np.array(sizes, dtype=np.int64)


def signatures(hashes: list) -> np.ndarray:
    """Minwise values, one row of COORDS 32-bit numbers for each non-empty set."""
    flat = np.concatenate(hashes)
    starts = np.cumsum([0, *map(len, hashes[:-1])])
    out = np.empty((len(hashes), COORDS), dtype=np.uint32)
    cut = 1 << 17  # work on parts that stay in a processor's cache
    for c in range(COORDS):
        for lo in range(0, len(hashes), 512):
            hi = min(len(hashes), lo + 512)
            a, b = starts[lo], starts[hi] if hi < len(hashes) else len(flat)
            part = (flat[a:b] * _MULT[c] + _ADD[c]) >> np.uint64(32)
            out[lo:hi, c] = np.minimum.reduceat(part, starts[lo:hi] - a)
    return out


def _describe(width: int):
    def run(batches):
        for part in slices(batches):
            if part.num_rows:
                hashes, sizes = shingle_sets(part.column(1).to_pylist(), width)
                full = np.flatnonzero(sizes)
                keys, sigs = [None] * len(sizes), [None] * len(sizes)
                if len(full):
                    sig = signatures([hashes[i] for i in full])
                    for row, i in enumerate(full.tolist()):
                        keys[i] = hashlib.blake2b(hashes[i].tobytes(), digest_size=16).digest()
                        sigs[i] = sig[row].tobytes()
                others = [k for k, name in enumerate(part.schema.names) if name != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in others), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                                                 names=[*(part.schema.names[k] for k in others), "n", "key", "sig"])

    return run


def _chosen(node: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unused coordinates that a node branches on: one, and in a quarter of the nodes another."""
    h = mix(node + _MIX)

    def unused(coord, taken):
        coord = coord % COORDS
        while (hit := (taken >> coord.astype(np.uint64)) & np.uint64(1) == 1).any():
            coord = np.where(hit, (coord + 1) % COORDS, coord)
        return coord

    first = unused((h % np.uint64(COORDS)).astype(np.int64), used)
    second = unused(((h >> np.uint64(8)) % np.uint64(COORDS)).astype(np.int64), used | np.uint64(1) << first.astype(np.uint64))
    return first, second, (h >> np.uint64(40)) % np.uint64(4) == 0


def _branch(trees: int | None):
    """Children of (node, key, used, parent, sig) rows; with ``trees``, of every tree's root for (key, sig) rows."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
            rows = np.arange(len(sig))
            nodes = ([np.full(len(sig), mix(np.array([t + 1], dtype=np.uint64))[0]) for t in range(trees)] if trees
                     else [batch.column("node").to_numpy().view(np.uint64)])
            used = np.zeros(len(sig), dtype=np.uint64) if trees else batch.column("used").to_numpy().view(np.uint64)
            out_node, out_row, out_used = [], [], []
            for k, node in enumerate(nodes):
                if trees:  # roots spread over all coordinates, so that trees are independent
                    first, second = np.full(len(sig), 4 * k % COORDS), np.full(len(sig), (4 * k + 1) % COORDS)
                    also = np.full(len(sig), k % 4 == 0)
                else:
                    first, second, also = _chosen(node, used)
                for coord, pick in ((first, rows), (second, rows[also])):
                    value = sig[pick, coord[pick]].astype(np.uint64)
                    out_node.append(mix(node[pick] * _MIX + (value << np.uint64(8)) + coord[pick].astype(np.uint64)))
                    out_used.append(used[pick] | np.uint64(1) << coord[pick].astype(np.uint64))
                    out_row.append(pick)
            at = pa.array(np.concatenate(out_row))
            parent = batch.column("size").take(at) if not trees else pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_node).view(np.int64)), batch.column("key").take(at), pa.array(np.concatenate(out_used).view(np.int64)), parent],
                                             names=["node", "key", "used", "parent"])

    return run


def _weights(i: int, n: np.ndarray, sketch: np.ndarray, num: int) -> np.ndarray:
    """Coordinates on which each member agrees with member ``i``; 0 where the sizes rule a link out."""
    fits = 100 * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])
    return np.where(fits, (sketch == sketch[i]).sum(1), 0)


def _forest(n: np.ndarray, sketch: np.ndarray, num: int) -> list[tuple[int, int, int]]:
    """Pairs of a maximum spanning forest over the pairs that agree well enough, and the tree of each."""
    best, came, out = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64), []
    tree = list(range(len(n)))
    at = 0
    best[0] = -1
    for _ in range(len(n) - 1):
        weight = _weights(at, n, sketch, num)
        better = (weight > best) & (best >= 0)
        best[better], came[better] = weight[better], at
        at = int(best.argmax())
        if best[at] >= SKETCH_MIN:
            tree[at] = tree[came[at]]
            out.append((int(came[at]), at, tree[at]))
        elif best[at] <= 0:
            at = int(np.flatnonzero(best == 0)[0])
        best[at] = -1
    return out


def _between(sets: list[np.ndarray], num: int, roots: list) -> list[tuple[int, int]]:
    """Exact links between members of different components, one for a member and another component."""
    names = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    root = np.array([names[r] for r in roots])
    n = np.array(list(map(len, sets)))
    owner = np.repeat(np.arange(len(sets)), n)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    posting, first = owner[order], np.r_[0, np.cumsum(np.bincount(ids))]
    at = np.r_[0, np.cumsum(n)]
    del owner, order
    largest, out = np.bincount(root).argmax(), []
    # a link between components has an end outside the largest one
    for i in np.flatnonzero(root != largest).tolist():
        own = ids[at[i]:at[i + 1]]
        shared = np.bincount(np.concatenate([posting[first[k]:first[k + 1]] for k in own.tolist()]), minlength=len(sets))
        linked = np.flatnonzero((100 * shared >= num * (n + n[i] - shared)) & (root != root[i]))
        out += [(i, int(linked[k])) for k in np.unique(root[linked], return_index=True)[1]]
    return out


def _node_pairs(num: int, with_sets: bool):
    """Pairs of nodes; rows come sorted by node.

    Without sets, candidates of a node's spanning forest, named by their tree; with them, exact links between components.
    """

    def likely(edges, n, sketch):
        """Nodes that can have a pair: of small ones, all pairs are looked at together."""
        size = np.diff(edges)
        hit = size > 8
        node = np.repeat(np.arange(len(size)), size)
        for d in range(1, 8):
            i = np.flatnonzero((node[d:] == node[:-d]) & (size[node[:-d]] <= 8))
            good = (sketch[i] == sketch[i + d]).sum(1) >= SKETCH_MIN
            good &= 100 * np.minimum(n[i], n[i + d]) >= num * np.maximum(n[i], n[i + d])
            hit[node[i[good]]] = True
        return np.flatnonzero(hit)

    def run(batches):
        held = None
        for batch in _then_none(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            node = held.column("node").to_numpy()
            edges = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            if batch is not None:
                edges = edges[:-1]  # the last node may go on in the next batch
            if len(edges) < 2:
                continue
            stop = int(edges[-1])
            done = held.slice(0, stop)
            keys = done.column("key").to_pylist()
            if with_sets:
                roots, sets = done.column("root").to_pylist(), done.column("set")
            else:
                n = done.column("n").to_numpy()
                sketch = np.frombuffer(b"".join(done.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, COORDS)
            out = [[], [], []]
            for k in range(len(edges) - 1) if with_sets else likely(edges, n, sketch).tolist():
                lo, hi = int(edges[k]), int(edges[k + 1])
                pairs = _between([np.frombuffer(x.as_buffer(), np.uint64) for x in sets.slice(lo, hi - lo)], num, roots[lo:hi]) if with_sets else _forest(n[lo:hi], sketch[lo:hi], num)
                for i, j, *tree in pairs:
                    a, b = sorted((keys[lo + i], keys[lo + j]))
                    name = int(mix(node[lo:lo + 1].view(np.uint64) + _MIX * np.array(tree[:1], dtype=np.uint64)).view(np.int64)[0]) if tree else int(node[lo])
                    for column, value in zip(out, (name, a, b)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["node", "a", "b"])
            held = held.slice(stop)

    return run


def _then_none(batches):
    yield from batches
    yield None


def _sketches(batches):
    """One byte of every coordinate."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary())], names=["key", "n", "sketch"])


def leaves(classes: DataFrame, confirm) -> tuple[DataFrame, DataFrame]:
    """(node, key, n, sketch) of every node that is compared, of about LEAF members at most, and links (a, b) confirmed on the way."""
    sketches = stored(classes.select("key", "n", "sig").mapInArrow(_sketches, "key binary, n long, sketch binary"), "sketches")
    schema = "node long, key binary, used long, parent long"
    rows = classes.select("key", "sig").mapInArrow(_branch(TREES), schema)
    parts, crowds = [], []
    for level in range(LEVELS):
        rows = stored(rows, "paths")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        members = stored(rows.join(sizes, "node"), "members")
        parts.append(members.filter(f"size <= {LEAF}").select("node", "key"))
        large = members.filter(f"size > {LEAF}")
        if large.isEmpty():
            break
        stuck = F.lit(True) if level == LEVELS - 1 else F.coalesce(F.col("size") >= STUCK * F.col("parent"), F.lit(False))
        crowds.append(large.filter(stuck).select("node", "key"))
        large = large.filter(~stuck).select("node", "key", "used", "size")
        rows = large.join(classes.select("key", "sig"), "key").mapInArrow(_branch(None), schema)
    union = lambda frames: functools.reduce(DataFrame.union, frames)
    stars = classes.sparkSession.createDataFrame([], "a binary, b binary")
    if crowds:
        crowded = stored(union(crowds), "crowded")
        if not crowded.isEmpty():
            stars, blocks = _blocks(crowded, confirm)
            parts.append(blocks)
    return stored(union(parts).join(sketches, "key").select("node", "key", "n", "sketch"), "leaves"), stars


def _blocks(crowded: DataFrame, confirm) -> tuple[DataFrame, DataFrame]:
    """Links of members to representatives, and (node, key) of the pairs of blocks that crowded nodes are compared in."""
    stars, left, roots = [], crowded, None
    for _ in range(STARS):
        heads = left.groupBy("node").agg(F.min("key").alias("head"))
        pairs = left.join(heads, "node").filter("key != head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()
        stars.append(stored(confirm(pairs), "stars"))
        roots = stored(components(functools.reduce(DataFrame.union, stars)), "starred")
        rooted = left.join(roots.withColumnRenamed("node", "key"), "key", "left").select("node", "key", F.coalesce("root", "key").alias("root"))
        ends = heads.join(roots.withColumnRenamed("node", "head"), "head", "left").select("node", F.coalesce("root", "head").alias("root"))
        left = stored(rooted.join(ends, ["node", "root"], "left_anti").select("node", "key"), "unlinked")
        if left.isEmpty():
            break
    half = LEAF // 2
    rooted = crowded.join(roots.withColumnRenamed("node", "key"), "key", "left").select("node", "key", F.coalesce("root", "key").alias("root"))
    rooted = stored(rooted, "rooted")
    # members of a component that fills a block have blocks of their own; those of all others are mixed
    sizes = rooted.groupBy("node", "root").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.filter(f"size >= {half}").select("node", "root", F.ceil(F.col("size") / half).alias("many"), F.col("root").alias("one"))
    mixed = sizes.filter(f"size < {half}").groupBy("node").agg(F.ceil(F.sum("size") / half).alias("many"))
    dealt = rooted.join(whole, ["node", "root"], "left").join(mixed.withColumnRenamed("many", "mixed"), "node", "left")
    dealt = stored(dealt.select("node", "key", "one", F.pmod(F.xxhash64("key"), F.coalesce("many", "mixed")).alias("part")), "dealt")
    blocks = stored(whole.select("node", "one", "many").union(mixed.select("node", F.lit(None).cast("binary").alias("one"), "many"))
                    .select("node", "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("part")).withColumn("block", F.xxhash64("node", "one", "part")), "blocks")
    other = blocks.select("node", F.col("one").alias("one_"), F.col("block").alias("block_"))
    met = blocks.join(other, "node").filter("block <= block_ AND (one IS NULL OR one_ IS NULL OR one != one_)")
    met = stored(met.select(F.xxhash64("node", "block", "block_").alias("pair"), F.explode(F.array_distinct(F.array("block", "block_"))).alias("block")), "met")
    named = dealt.select(F.xxhash64("node", "one", "part").alias("block"), "key")
    return functools.reduce(DataFrame.union, stars), named.join(met, "block").select(F.col("pair").alias("node"), "key")


def _by_node(rows: DataFrame, num: int, with_sets: bool) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_node_pairs(num, with_sets), "node long, a binary, b binary")


def class_roots(docs: DataFrame, classes: DataFrame, width: int, num: int) -> DataFrame:
    """(node, root): components of class keys over all links that the trees' nodes can join."""
    nodes, stars = leaves(classes, lambda pairs: confirmed(docs, classes, pairs, width, num))
    forest = stored(_by_node(nodes, num, False), "forest")
    first = stored(confirmed(docs, classes, forest.select("a", "b").distinct(), width, num).union(stars.select("a", "b")).distinct(), "confirmed")
    roots = stored(components(first), "roots")
    end = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    ends = lambda pairs: pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").select("*", F.coalesce("root_a", "a").alias("u"), F.coalesce("root_b", "b").alias("v"))
    apart = stored(ends(forest.join(first, ["a", "b"], "left_anti")).filter("u != v").select("node", "a", "b"), "apart")
    if apart.isEmpty():
        return roots
    # a pair that agrees well enough lies within one tree, so the members of trees with a refused pair are all that matter
    broken = forest.join(apart.select("node").distinct(), "node", "left_semi")
    again = broken.select("node", F.col("a").alias("key")).union(broken.select("node", F.col("b").alias("key"))).distinct()
    again = stored(again.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select("node", "key", F.coalesce("root", "key").alias("root")), "again")
    again = again.join(full_sets(docs, classes, again.select("key"), width), "key")
    second = stored(ends(_by_node(again, num, True).select("a", "b").distinct()).select(F.col("u").alias("a"), F.col("v").alias("b")), "second")
    if second.isEmpty():
        return roots
    # components of components; a component's new name goes to all of its members
    joined = stored(components(second).select(F.col("node").alias("root"), F.col("root").alias("above")), "joined")
    alone = joined.select(F.col("root").alias("node"), F.col("above").alias("root")).join(roots.select("node"), "node", "left_anti")
    return roots.join(joined, "root", "left").select("node", F.coalesce("above", "root").alias("root")).union(alone)


def _sets(width: int):
    def run(batches):
        for part in slices(batches):
            if part.num_rows:
                packed = [h.tobytes() for h in shingle_sets(part.column(0).to_pylist(), width)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()), pa.array(packed, pa.binary())], names=["key", "set"])

    return run


def _confirm(num: int):
    def run(batches):
        for batch in slices(batches):
            good = []
            for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * shared >= num * (len(a) + len(b) - shared))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def full_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, set) of the classes in ``keys``, from the texts of their least ids (and of other classes that share these ids)."""
    # written first, so that its size is known when it meets the texts
    reps = stored(classes.join(keys, "key", "left_semi").select("rep").distinct(), "reps")
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(reps, F.col("_id").eqNullSafe(F.col("rep")), "left_semi")
    return stored(texts.select("text").mapInArrow(_sets(width), "key binary, set binary").dropDuplicates(["key"]), "sets")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, num: int) -> DataFrame:
    """The candidate pairs whose full sets reach the threshold."""
    pairs = stored(pairs, "pairs")
    sets = full_sets(docs, classes, pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))), width)
    side = lambda s: sets.select(F.col("key").alias(s), F.col("set").alias(f"set_{s}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(num), "a binary, b binary")


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class's key, classes, and components of classes; columns beside doc_id and text stay with the rows."""
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    described = stored(docs.mapInArrow(_describe(width), f"{kept}n long, key binary, sig binary"), "shingled")
    classes = stored(described.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    return described, classes, stored(class_roots(docs.select("doc_id", "text"), classes, width, percent), "roots")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the least id; rows without words stay, but only one of equal rows.

    A row is known by all of its columns, so ids may be null or repeated; rows equal in all of them are one row repeated.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.unhex(F.md5(F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))).cast("binary"))))
    described, _, roots = _linked(rows.select("doc_id", "text", F.col(name).alias("row")), width, percent)
    distinct = described.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.count(F.lit(1)).alias("copies"))
    named = distinct.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("root", "key", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row", "copies"))
    kept = stored(named.groupBy("group", F.col("key").isNull()).agg(first.alias("r")).select(F.col("r.row").alias(name), F.col("r.copies").alias("copies")), "kept")
    once = rows.join(kept.filter("copies = 1").select(name), name, "left_semi")
    # equal rows are reduced in each task before they meet
    again = rows.join(kept.filter("copies > 1").select(name), name, "left_semi").withColumn(name, F.hex(name)).dropDuplicates([name])
    return once.select(*docs.columns).union(again.select(*docs.columns))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    described, classes, roots = _linked(docs.select("doc_id", "text"), width, percent)
    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key")
    names = named.groupBy("root").agg(F.min("rep").alias("linked_id"))
    linked = named.select("key", "root").join(names, "root").select("key", "linked_id")
    by_class = classes.select("key", "rep").join(linked, "key", "left").select("key", F.coalesce("linked_id", "rep").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "key").join(by_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def dedup_ctes(docs: str, prefix: str, width: int) -> str:
    """DuckDB CTEs: ``{prefix}_named`` has (doc_id, n_shingles, component_id) for the rows of ``docs`` (unique doc_id)."""
    p = prefix
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = " || chr(9) || ".join(f"w[i+{k}]" if k else "w[i]" for k in range(width))
    return f"""
{p}_words AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
{p}_sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, {gram} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {width - 2})) AS i FROM {p}_words WHERE len(w) >= {width})
  UNION ALL SELECT doc_id, chr(10) || array_to_string(w, chr(9)) FROM {p}_words WHERE len(w) BETWEEN 1 AND {width - 1}),
{p}_sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM {p}_sets GROUP BY doc_id),
{p}_links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM {p}_sets x JOIN {p}_sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN {p}_sizes p ON p.doc_id = a JOIN {p}_sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
{p}_both AS MATERIALIZED (SELECT a, b FROM {p}_links UNION ALL SELECT b, a FROM {p}_links),
{p}_reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM {docs} UNION SELECT r.doc_id, e.b FROM {p}_reach r JOIN {p}_both e ON r.other = e.a),
{p}_named AS (
  SELECT r.doc_id, CAST(coalesce(any_value(z.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
  FROM {p}_reach r LEFT JOIN {p}_sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id)"""


SQL = f"WITH RECURSIVE {dedup_ctes('documents', 'd', 2)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM d_named"
