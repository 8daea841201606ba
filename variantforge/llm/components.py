"""Connected components of a link table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A contracted graph of at most so many links is finished in one task; larger ones go on contracting.
LAST_LINKS = 10_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(p, p)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "up"])


def components(links: DataFrame, scratch: Scratch, name: str, stored: bool = False) -> DataFrame:
    """(node, root) for every node of links (a, b): nodes joined by links, in either direction, share a root.

    Each round points every node to its neighbour of least keyed hash (a partial minimum, so a hub's rows
    are combined before they move) and replaces links by links between those; hashing anew each round
    keeps chains from contracting a node at a time.  Self links count only as nodes.  stored: links are read
    from tables already.
    """
    links = links.select("a", "b") if stored else scratch.cut(links.select("a", "b"), f"{name}_links")
    steps: list[DataFrame] = []
    for k in range(1 << 20):
        proper = links.where("a <> b")
        if proper.count() <= LAST_LINKS:
            steps.append(scratch.cut(proper.coalesce(1).mapInArrow(_finish, "node bigint, up bigint"), f"{name}_step{k}"))
            break
        both = proper.select("a", "b").unionByName(proper.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("b"))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("m"))
        least = least.select("node", F.when(F.col("m") < rank("node"), F.col("m.b")).otherwise(F.col("node")).alias("up"))
        step = scratch.cut(least, f"{name}_step{k}")
        steps.append(step)
        one = proper.join(step.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").select("ua", "b")
        two = one.join(step.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        links = scratch.cut(two.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), f"{name}_links{k}")
    total = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), F.col("up").alias("further"))
        total = total.join(nxt, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return total
