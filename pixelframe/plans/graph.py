"""Connected parts of a graph by root hooking.

Every round hooks each node onto its least neighbour, if that is smaller, follows the hooks until
every node points at a root, and carries the edges over to the roots. A root that survives a round
has taken in all its neighbours or gets a smaller one, so two rounds at least halve the roots of
every part that is not finished: rounds are logarithmic in the nodes, whatever the graph's diameter.
Finished nodes leave the graph; later rounds see roots only.

A root may have any number of nodes below it, and of edges: joins on it are salted.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sizing import grows, is_empty
from .skew import salted_join


def _follow(hooks: DataFrame, keys: list[str]) -> DataFrame:
    """`(node, root)` for nodes that are no root, from `(node, parent)` of all nodes.

    Pointers double: a round joins every open node with where its parent points. Nodes that point
    at a root are settled and leave.
    """
    final = F.col("node") == F.col("parent")
    pointers, settled = hooks.withColumn("_final", final), None
    open_rows = hooks.filter(~final)
    while True:
        ahead = pointers.select(
            *keys, F.col("node").alias("parent"), F.col("parent").alias("_next"), "_final")
        # Only nodes are parents, so every row meets one.
        jumped = cut(salted_join(open_rows, grows(ahead), [*keys, "parent"], ["node"], "inner"))
        done = jumped.filter("_final").select(*keys, "node", F.col("_next").alias("root"))
        settled = done if settled is None else settled.unionByName(done)
        open_rows = jumped.filter("not _final").select(
            *keys, "node", F.col("_next").alias("parent")
        )
        if is_empty(open_rows):
            return settled
        pointers = open_rows.withColumn("_final", F.lit(False)).unionByName(
            settled.withColumnRenamed("root", "parent")
            .unionByName(hooks.filter(final)).withColumn("_final", F.lit(True))
        )


def contract(
    links: DataFrame, keys: Sequence[str], each_round: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """`(keys, node, root)` for every node of a connected part but its least, which is the root.

    `links(keys, a, b)` are distinct and hold both directions of every edge. `each_round` is shown
    the edges a round starts with.
    """
    keys = list(keys)
    forests = []
    edges = links
    while not is_empty(edges):
        if each_round is not None:
            each_round(edges)
        hooks = cut(edges.groupBy(*keys, F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.col("a")).alias("parent")
        ))
        forest = cut(_follow(hooks, keys))
        forests.append(forest)
        moved = edges
        for end, other in (("a", "b"), ("b", "a")):
            to = forest.select(*keys, F.col("node").alias(end), F.col("root").alias("_root"))
            moved = salted_join(moved, grows(to), [*keys, end], [other]).select(
                *keys, F.coalesce("_root", end).alias(end), other
            )
        edges = cut(moved.filter("a <> b").select(*keys, "a", "b").distinct())
    if not forests:
        return links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last round back: a root of one round may be a node of the next.
    whole = forests[-1]
    for forest in reversed(forests[:-1]):
        to = whole.select(*keys, F.col("node").alias("root"), F.col("root").alias("_root"))
        lifted = salted_join(forest, grows(to), [*keys, "root"], ["node"]).select(
            *keys, "node", F.coalesce("_root", "root").alias("root")
        )
        whole = lifted.unionByName(whole)
    return whole
