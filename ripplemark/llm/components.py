"""Connected components of a link table: spanning forests of its parts, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import Scratch, map_arrow

#: Links that one task reads, about.
PART = 1_000_000


def _forest(batches):
    """Links of a part (u, v) as links of each node to the least node that they reach; at most one for each node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    out = np.array([(x, find(x)) for x in nodes], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["u", "v"])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step. pairs: u, v with u > v; the result has the same form.

    Large: the greater neighbours of a node are linked to its least neighbour. Small: the lesser ones
    and the node itself are. Least neighbours come from an aggregation, so no neighbour list is gathered.
    """
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """node, component for every node of a link table (a, b long): the component is its least node.

    Every part of about PART links becomes a forest in one task. If there are more parts, stars join the forests, in a number of
    rounds that is logarithmic in the number of nodes for all practical graphs, each a table in the shared folder. Raises if it
    does not settle.
    """
    links = scratch.save(links.where("a <> b").select("a", "b"), f"{name}-links")
    parts = max(1, -(-links.count() // PART))
    pairs = scratch.save(map_arrow(links.coalesce(parts), _forest, "u long, v long"), f"{name}-0")
    scratch.drop(f"{name}-links")
    mark = None
    for k in range(1, most_rounds if parts > 1 else 1):
        new = scratch.save(_star(_star(pairs, True), False), f"{name}-{k}")
        seen = tuple(new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        scratch.drop(f"{name}-{k - 1}")
        pairs = new
        if seen == mark:
            break
        mark = seen
    else:
        if parts > 1:
            raise RuntimeError("components did not settle")
    # every pair leads from a node to the least node of its component now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
