"""Connected components of a graph of any size: union-find inside tasks, pointer jumping between them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelframe.session import cut

STAR = "node long, root long"


def contract(batches):
    """Edges of one task to a star per component: (node, root) with root the smallest node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, find(x)) for x in parent if find(x) != x]
    nodes, roots = zip(*stars) if stars else ((), ())
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (two long columns, no nulls) but each component's smallest.

    A round brings all edges of a node into one task, where union-find makes stars of them, and then
    moves every node to the least root of its root. A task also tells links between roots, so a node may
    get roots from several tasks. It ends when no node has two roots and no root is a node.
    """
    a, b = edges.columns
    stars = cut(edges.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(contract, STAR))
    while True:
        merged = cut(stars.repartition("node").mapInArrow(contract, STAR))
        # One row per root: a root that several tasks moved keeps all its edges, of which others follow the least.
        above = merged.groupBy(F.col("node").alias("root")).agg(F.min("root").alias("top"))
        moved = merged.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        stars = cut(moved)
        nodes = stars.groupBy("node").agg((F.max("moved") | (F.min("root") < F.max("root"))).alias("open"))
        state = nodes.agg(F.max("open").alias("open")).first()
        stars = stars.select("node", "root").distinct()
        if not state["open"]:
            return stars
