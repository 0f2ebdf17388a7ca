"""Connected components by alternating large-star and small-star joins on DataFrames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_staged, staged


#: Edges up to which one task settles all components at once: about 100 MB there.
ONE_TASK_EDGES = 1 << 18


def _of_few(pairs: DataFrame) -> DataFrame:
    """node, component of a measured, small number of edges by union and find in one executor task."""
    kind = pairs.schema["u"].dataType.simpleString()

    def settle(batches):
        parent: dict = {}

        def head(n):
            while parent.setdefault(n, n) != n:
                parent[n] = n = parent[parent[n]]
            return n

        field = None
        for batch in batches:
            field = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = head(u), head(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        for at in range(0, len(nodes), 65536):
            part = nodes[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part, field), pa.array([head(n) for n in part], field)], ["node", "component"])

    return pairs.select("u", "v").coalesce(1).mapInArrow(settle, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Smallest reachable node of every node that has an edge: columns node, component.

    Each round points all larger neighbours at the smallest neighbour (large star), then all
    smaller ones (small star); rounds grow with the logarithm of the path length. A hub's
    edges are reduced by partial minima before any shuffle, and no link reaches the driver.
    Distinct edges up to one_task, by count, are settled in one task without rounds.
    Self-loops give the node itself; null endpoints take no part; no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    pairs = staged(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if pairs.count() <= one_task:
        found = staged(_of_few(pairs))
        drop_staged(pairs)
        return found.unionByName(loops.join(found, "node", "left_anti").withColumn("component", F.col("node")))
    signature = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small)
        drop_staged(large, pairs)
        pairs = new
        got = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if got == signature:
            break
        signature = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    found = found.unionByName(roots)
    return found.unionByName(loops.join(found, "node", "left_anti").withColumn("component", F.col("node")))
