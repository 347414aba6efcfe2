"""Operator 2: near duplicates among embeddings by a pivot-permutation index.

Reference points ("pivots") are chosen from a bounded sample of the vectors, ``PIVOTS`` of
them at most and else about twice the square root of their number.  No two
pivots are closer than a cosine bound below the threshold, so that a group of
near vectors owns few of them, however many rows it has.  The bound is the
least of ``BOUNDS`` at which half of the wanted pivots are found.
Each distinct vector is described by its ``NEAREST`` nearest pivots in order, and this
permutation, without the vector, is entered in those pivots' inverted lists.

Retrieval: in each list the pivots that two members share are counted, and pairs
with ``SHARED`` of them or more are candidates.  A pair belongs to the list of its
smallest shared pivot only, so links are counted without ever writing pairs: a list
writes its members that have a candidate.  Lists longer than ``BLOCK`` are
counted in pairs of blocks, each a task of its own.
Verification: vectors are joined to those members alone, and each list compares
its candidates by cosine in double precision.  It writes each member's number of
links and the smallest member that it is linked to there through others.

Equal vectors are one class, entered once with its number of copies.  Vectors
of different lengths have no cosine; each length has an index of its own.
The index is approximate: links found among planted groups are in the README.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing;
a null id takes part but names no component unless all ids there are null;
repeated rows are copies; equally near pivots may come in either order; labels
and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import slices, stored, table
from .components import components

PIVOTS = 65_536
NEAREST = 8
#: Pivots that a candidate pair shares.
SHARED = 3
BLOCK = 4096
#: Cosines that two pivots may have at most, and how many vectors are looked at for each wanted pivot.
BOUNDS = (0.5, 0.6, 0.7, 0.8)
LOOKED_AT = 2


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _apart(unit: np.ndarray, bound: float, most: int) -> np.ndarray:
    """Indices of the first ``most`` rows that have no cosine over ``bound`` with an earlier chosen one."""
    chosen: list[int] = []
    for lo in range(0, len(unit), 256):
        part = unit[lo:lo + 256]
        free = (part @ unit[chosen].T <= bound).all(1)
        own = part @ part.T > bound
        for i in range(len(part)):
            if free[i]:
                chosen.append(lo + i)
                free[i + 1:] &= ~own[i, i + 1:]
                if len(chosen) == most:
                    return np.array(chosen)
    return np.array(chosen, dtype=np.int64)


def separated(sample: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Pivots out of ``sample``: half of ``most`` at least where some bound allows it."""
    unit = _unit(sample)
    for bound in [b for b in BOUNDS if b <= threshold - 0.1] or [threshold - 0.1]:
        chosen = _apart(unit, bound, most)
        if 2 * len(chosen) >= most:
            break
    return unit[chosen]


def _describe(unit: np.ndarray):
    """Each vector's nearest pivots in order."""
    k = min(NEAREST, len(unit))

    def run(batches):
        for part in slices(batches, max(1, 4_000_000 // len(unit))):
            if part.num_rows:
                sims = _unit(_matrix(part.column("vec"))) @ unit.T
                some = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(sims, some, 1), axis=1, kind="stable")
                near = pa.array(np.take_along_axis(some, order, 1).astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.FixedSizeListArray.from_arrays(near, k).cast(pa.list_(pa.int32()))], names=["key", "near"])

    return run


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable over links (a, b) and those that ``root`` comes from."""
    while True:
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        root = new[root]


def _rows_by_pivot(near: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(near, axis=None, kind="stable")
    values, starts = np.unique(near.ravel()[order], return_index=True)
    return dict(zip(values.tolist(), np.split(order // near.shape[1], starts[1:])))


def candidates(pivot: int, a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (permutations in the list of ``pivot``) share ``need`` pivots, none before ``pivot``."""
    shared = np.zeros((len(a), len(b)), dtype=np.int8)
    of_a, of_b = _rows_by_pivot(a), _rows_by_pivot(b)
    for p in of_a.keys() & of_b.keys():
        u, v = of_a[p], of_b[p]
        step = np.int8(1 if p >= pivot else -NEAREST - 1)  # with one earlier pivot the sum stays below zero
        if 8 * len(u) * len(v) > shared.size:
            in_a, in_b = np.zeros(len(a), dtype=np.int8), np.zeros(len(b), dtype=np.int8)
            in_a[u], in_b[v] = step, 1
            shared += in_a[:, None] * in_b
        else:
            shared[np.ix_(u, v)] += step
    return shared >= need


def _sides(group: pa.Table, i: int, j: int):
    """A block pair's rows: places of the one side and of the other, and all permutations."""
    part = group.column("part").to_numpy()
    near = group.column("near").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
    return np.flatnonzero(part == i), np.flatnonzero(part == j), near


def _retrieve(key, group):
    """The members of a list, or of two of its blocks, that have a candidate there."""
    pivot, i, j = (x.as_py() for x in key)
    a, b, near = _sides(group, i, j)
    pairs = candidates(pivot, near[a], near[b], min(SHARED, near.shape[1]))
    if i == j:
        np.fill_diagonal(pairs, False)
    rows = np.unique(np.concatenate([a[pairs.any(1)], b[pairs.any(0)]]))
    return group.select(["pivot", "i", "j", "part", "key", "near"]).take(pa.array(rows))


def _verify(threshold: float):
    def run(key, group):
        pivot, i, j = (x.as_py() for x in key)
        a, b, near = _sides(group, i, j)
        pairs = candidates(pivot, near[a], near[b], min(SHARED, near.shape[1]))
        if i == j:
            pairs = np.triu(pairs, 1)
        x, copies = _unit(_matrix(group.column("vec").combine_chunks())), group.column("copies").to_numpy()
        n_links, root = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for lo in range(0, len(a), 512):
            some, left = pairs[lo:lo + 512], a[lo:lo + 512]
            u, v = np.nonzero(some)
            if 64 * len(u) > some.size:
                u, v = np.nonzero((x[left] @ x[b].T >= threshold) & some)
            elif len(u):
                good = np.concatenate([np.einsum("ij,ij->i", x[left[u[s:s + 4096]]], x[b[v[s:s + 4096]]]) for s in range(0, len(u), 4096)]) >= threshold
                u, v = u[good], v[good]
            u, v = left[u], b[v]
            np.add.at(n_links, u, copies[v])
            np.add.at(n_links, v, copies[u])
            root = _roots(root, u, v)
        rows = np.flatnonzero(n_links)
        keys = group.column("key")
        return pa.table([keys.take(pa.array(rows)), keys.take(pa.array(root[rows])), pa.array(n_links[rows])], names=["key", "root", "n"])

    return run


def _sample(classes: DataFrame, n: int, most: int) -> np.ndarray:
    """The vectors of the ``most`` least hashes; tasks send little more than that together."""
    hashed = classes.select(F.xxhash64("key").alias("h"), "key", "vec")
    share = (most + 5 * math.sqrt(most)) / n  # five deviations more than wanted
    if share < 1:
        hashed = hashed.filter(F.col("h") < int(share * 2.0 ** 64) - 2 ** 63)
    rows = hashed.toArrow().sort_by([("h", "ascending"), ("key", "ascending")])
    return _matrix(rows.slice(0, most).column("vec").combine_chunks())


def _list_links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(key, root, n) of the ``n`` classes of one length: what each list of the index finds of each member."""
    most = min(PIVOTS, max(16, math.ceil(2 * math.sqrt(n))))
    pivots = separated(_sample(classes, n, LOOKED_AT * most), most, threshold)
    described = stored(classes.select("key", "vec").mapInArrow(_describe(pivots), "key binary, near array<int>"), "described")
    entered = described.select(F.explode("near").alias("pivot"), "key", "near")
    # lists in blocks: members of a block meet each other and the members of every other block of the list
    blocks = {r.pivot: -(-r["count"] // BLOCK) for r in entered.groupBy("pivot").count().filter(f"count > {BLOCK}").collect()}  # PIVOTS rows at most
    many = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv)), F.col("pivot")), F.lit(1)) if blocks else F.lit(1)
    dealt = entered.withColumn("many", many.cast("int")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("many")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    dealt = dealt.select("pivot", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "key", "near")
    found = dealt.groupBy("pivot", "i", "j").applyInArrow(_retrieve, "pivot int, i int, j int, part int, key binary, near array<int>")
    found = stored(found, "retrieved").join(classes.select("key", "copies", "vec"), "key")
    return stored(found.groupBy("pivot", "i", "j").applyInArrow(_verify(threshold), "key binary, root binary, n long"), "partial")


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    kind = "array<float>" if vectors.schema[vec_col].dataType == ArrayType(FloatType(), vectors.schema[vec_col].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(kind).alias("vec"))
    usable = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    keyed = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.unhex(F.md5(F.to_json(F.struct(F.transform("vec", lambda x: x + 0.0).alias("v"))).cast("binary")))))
    keyed = stored(keyed, "vectors")
    classes = stored(keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")), "classes")
    lengths = [(r.d, r["count"]) for r in classes.groupBy(F.size("vec").alias("d")).count().orderBy("d").collect()]  # as many as there are lengths
    if not lengths:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = [_list_links(classes if len(lengths) == 1 else classes.filter(F.size("vec") == d), n, threshold) for d, n in lengths if n > 1 or len(lengths) == 1]
    partial = functools.reduce(DataFrame.union, found) if found else keyed.sparkSession.createDataFrame([], "key binary, root binary, n long")
    counts = partial.groupBy("key").agg(F.sum("n").alias("n"))
    roots = stored(components(partial.select(F.col("key").alias("a"), F.col("root").alias("b"))), "roots")
    named = classes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key")
    linked = named.join(named.groupBy("root").agg(F.min("rep").alias("linked_id")), "root").select("key", "linked_id")
    by_class = (classes.select("key", "rep", "copies").join(counts, "key", "left").join(linked, "key", "left")
                .select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("linked_id", "rep").alias("component_id")))
    out = keyed.select("vec_id", "key").join(by_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_dot_product(x, x) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / a.norm / b.norm >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reach r LEFT JOIN counts c ON c.vec_id = r.vec_id GROUP BY r.vec_id"""
