"""Connected components of a link table.

Links are reduced to stars in each task.  What is left after that is joined in
a single task where it is at most ``LINKS`` links, a bounded piece of work
that needs no rounds.  More links take rounds of joins and grouped minima, each
moving every link towards the smallest member (large-star, then small-star);
hubs are handled by partial minima and splittable joins, never by collecting
neighbours.  Links are written to the shared folder each round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Most links that one task joins by itself: some 60 MB of Python objects.
LINKS = 200_000


class _Stars:
    """Links joined one by one; each node's root is the least node that it is joined to."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        above = self.above
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    def add(self, batch: pa.RecordBatch) -> None:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            u, v = sorted((self.root(u), self.root(v)))
            self.above[v] = u

    def rows(self, schema: pa.Schema, roots: bool) -> pa.RecordBatch:
        stars = [(x, self.root(x)) for x in list(self.above)]
        stars = stars if roots else [(x, y) for x, y in stars if x != y]
        return pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], schema.field(k).type) for k in (0, 1)], names=["node", "root"] if roots else ["u", "v"])


def _contract(batches):
    """The links of a batch as stars: each node with the least one that the batch joins it to."""
    for batch in batches:
        stars = _Stars()
        stars.add(batch)
        yield stars.rows(batch.schema, False)


def _joined(batches):
    """(node, root) of all links of a task."""
    stars, schema = _Stars(), None
    for batch in batches:
        stars.add(batch)
        schema = batch.schema
    if schema is not None:
        yield stars.rows(schema, True)


def components(links: DataFrame, most_rounds: int = 60, in_one_task: int = LINKS) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any orderable type).  Root is the least node reachable."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    edges = stored(edges.mapInArrow(_contract, edges.schema).distinct(), "links")
    if edges.count() <= in_one_task:
        kind = edges.schema["u"].dataType.simpleString()
        return stored(edges.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "joined")
    state = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        edges = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
