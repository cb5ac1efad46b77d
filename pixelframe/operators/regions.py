"""4-connected components, regions around seeds and path-distance budgets.

Work inside a block of pixels is done with NumPy on one bounded group; everything between blocks is
joins and groupings on a graph that holds block borders only.
"""

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import contract
from ..plans.ordered import take_lowest
from ..plans.sizing import grows, is_empty
from ..session import cut, ensure_checkpoint_dir

BLOCK = 128
# Beyond any path length, yet exact as a float: missing starts arrive from Arrow as NaN.
FAR = 1 << 52
STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1))

# Pixel number inside a scene: rows this far apart never collide for scenes below 2^31 columns.
ROW_STRIDE = 1 << 31


def _blocks(mask: DataFrame, block: int) -> DataFrame:
    return mask.withColumn("by", F.floor(F.col("y") / block)).withColumn(
        "bx", F.floor(F.col("x") / block)
    )


def _schema(df: DataFrame, names: Sequence[str], extra: str) -> str:
    kept = ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)
    return f"{kept}, {extra}"


def _local_labels(group: np.ndarray, ys: np.ndarray, xs: np.ndarray, block: int) -> np.ndarray:
    """Smallest pixel number of each pixel's component, for whole blocks in order of (group, y, x).

    Roots hook onto smaller neighbours and pointers double, for all blocks at once.
    """
    n = len(ys)
    cell = group.astype(np.int64) * (block * block) + ys % block * block + xs % block
    beside = np.flatnonzero((np.diff(cell) == 1) & (np.diff(ys) == 0))
    upper = np.flatnonzero(ys % block < block - 1)
    under = np.searchsorted(cell, cell[upper] + block)
    there = np.minimum(under, n - 1)
    met = (under < n) & (cell[there] == cell[upper] + block)
    a = np.concatenate([beside, upper[met]])
    b = np.concatenate([beside + 1, there[met]])
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while not np.array_equal(root, ahead := root[root]):
            root = ahead
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return (ys.astype(np.int64) * ROW_STRIDE + xs)[root]


def _starts(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Rows of a sorted batch at which any of `columns` changes, the first among them."""
    change = np.zeros(batch.num_rows, bool)
    change[:1] = True
    for name in columns:
        column = batch.column(name)
        change[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return np.flatnonzero(change)


def _labeller(keys: list[str], block: int):
    """Pixels sorted by block to the same rows with `local`; holds one block and one batch."""
    at = [*keys, "by", "bx"]

    def labelled(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts = _starts(batch, at)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
        ys, xs = (batch.column(c).to_numpy() for c in ("y", "x"))
        local = pa.array(_local_labels(group, ys, xs, block), pa.int64())
        kept = [*keys, "y", "x"]
        return pa.record_batch([*[batch.column(c) for c in kept], local], names=[*kept, "local"])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.concat_batches([*held, batch])
            last = int(_starts(whole, at)[-1]) if whole.num_rows else 0
            if last:
                yield labelled(whole.slice(0, last))
            held = [whole.slice(last)]
        if held and held[0].num_rows:
            yield labelled(held[0])

    return label


def components(
    mask: DataFrame, keys: Sequence[str] = ("image_id",), block: int = BLOCK
) -> DataFrame:
    """Add `component`: the smallest pixel number (y * 2^31 + x) of the 4-connected component.

    Blocks are labelled locally; touching labels of neighbouring blocks form a graph that root
    hooking contracts (`plans/graph.py`). The label does not depend on `block`.
    """
    keys = list(keys)
    pixels = _blocks(mask.select(*keys, "y", "x").distinct(), block)
    order = [*keys, "by", "bx"]
    local = cut(
        pixels.repartition(*order).sortWithinPartitions(*order, "y", "x")
        .mapInArrow(_labeller(keys, block), _schema(pixels, [*keys, "y", "x"], "local long"))
    )
    links = _block_links(local, keys, block)
    if is_empty(links):
        return local.withColumnRenamed("local", "component")
    roots = contract(links, keys)
    return (
        local.join(grows(roots.withColumnRenamed("node", "local")), [*keys, "local"], "left")
        .withColumn("component", F.coalesce("root", "local"))
        .drop("local", "root")
    )


def _block_links(local: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Distinct (a, b) labels that touch across a block border, both directions."""
    below = (F.col("y") + 1) % block == 0
    right = (F.col("x") + 1) % block == 0
    sources = local.filter(below).select(
        *keys, (F.col("y") + 1).alias("y"), "x", F.col("local").alias("a")
    ).unionByName(
        local.filter(right).select(
            *keys, "y", (F.col("x") + 1).alias("x"), F.col("local").alias("a")
        )
    )
    targets = local.filter((F.col("y") % block == 0) | (F.col("x") % block == 0))
    pairs = sources.join(grows(targets), [*keys, "y", "x"]).select(*keys, "a", F.col("local").alias("b"))
    both = pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
    return cut(both.distinct())


def region_of(mask: DataFrame, seeds: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pixels of each sample's mask that are 4-connected to its seed.

    `mask(sample_id, image_id, y, x)`, `seeds(sample_id, image_id, y, x)`.
    """
    keys = ["sample_id", "image_id"]
    labelled = components(mask, keys, block)
    roots = labelled.join(seeds.select(*keys, "y", "x"), [*keys, "y", "x"])
    roots = roots.select(*keys, "component").distinct()
    return labelled.join(roots, [*keys, "component"], "left_semi").select(*keys, "y", "x")


def _local_distance(
    ys: np.ndarray, xs: np.ndarray, start: np.ndarray
) -> np.ndarray:
    """Path distance inside one block from starting values (FAR where none)."""
    y0, x0 = ys.min(), xs.min()
    shape = (ys.max() - y0 + 3, xs.max() - x0 + 3)
    on = np.zeros(shape, dtype=bool)
    dist = np.full(shape, FAR, dtype=np.int64)
    at = (ys - y0 + 1, xs - x0 + 1)
    on[at] = True
    dist[at] = start
    ring = int(start.min())
    if ring == FAR:
        return start
    while True:
        front = on & (dist == ring)
        if front.any():
            for dy, dx in STEPS:
                reach = np.roll(front, (dy, dx), (0, 1)) & on & (dist > ring + 1)
                dist[reach] = ring + 1
        later = dist[(dist > ring) & (dist < FAR)]
        if not later.size:
            return dist[at]
        ring = int(later.min())


class _Store:
    """Versions of blocks in the shared folder: each round adds the blocks it improved, nothing else.

    A block row holds `dist` of its pixels in the order of the packed region, how many pixels it has
    per ring (equal distance), and the border pixels that this version improved.
    """

    VERSION = (
        "n long, dist array<long>, rings array<struct<ring: long, n: long>>, "
        "border array<struct<y: int, x: int, dist: long>>"
    )

    def __init__(self, region: DataFrame, keys: list[str], block: int):
        self.keys, self.at = keys, [*keys, "by", "bx"]
        spark = region.sparkSession
        ensure_checkpoint_dir(spark)
        self.path = f"{spark.sparkContext.getCheckpointDir()}/rings-{uuid.uuid4().hex}"
        self.spark, self.round = spark, 0
        pixels = _blocks(region.select(*keys, "y", "x").distinct(), block)
        self.blocks = cut(
            pixels.repartition(*self.at).groupBy(*self.at)
            .agg(F.collect_list(F.struct("y", "x")).alias("pixels"))
            .select(*self.at, F.col("pixels.y").alias("ys"), F.col("pixels.x").alias("xs"))
        )
        self.schema = _schema(self.blocks, self.at, self.VERSION)

    def add(self, improved: DataFrame) -> int:
        """Write a round's blocks; how many there are."""
        self.round += 1
        folder = f"{self.path}/round={self.round}"
        improved.write.parquet(folder)
        return self.spark.read.schema(self.schema).parquet(folder).count()

    def versions(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)

    def latest(self, *columns: str) -> DataFrame:
        """Each touched block's last version of `columns`; other columns are not read."""
        kept = F.max_by(F.struct(*columns), "round").alias("_v")
        return self.versions().groupBy(*self.at).agg(kept).select(
            *self.at, *[F.col(f"_v.{c}").alias(c) for c in columns]
        )

    def last_border(self) -> DataFrame:
        rows = self.versions().filter(F.col("round") == self.round)
        return rows.select(*self.keys, F.explode("border").alias("_p")).select(
            *self.keys, "_p.y", "_p.x", "_p.dist"
        )


def _far_limits(store: _Store, budget: int) -> DataFrame:
    """Distance of the ring that already holds the `budget`-th pixel, per sample that has as many."""
    per_ring = (
        store.latest("rings").select(*store.keys, F.explode("rings").alias("_r"))
        .groupBy(*store.keys, F.col("_r.ring").alias("ring")).agg(F.sum("_r.n").alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy(*store.keys).orderBy("ring"))
    return (
        per_ring.withColumn("_upto", upto).filter(F.col("_upto") >= budget)
        .groupBy(*store.keys).agg(F.min("ring").alias("_far"))
    )


def path_distance(
    region: DataFrame, seeds: DataFrame, budget: int | None = None, block: int = BLOCK
) -> DataFrame:
    """`dist`: steps through the region from each sample's seed; unreached pixels are absent.

    A frontier walks over blocks: a round relaxes the blocks that were offered values across their
    borders, and writes those that became nearer; settled blocks are not written again. Rounds follow
    blocks, not pixels. With a budget, values beyond the ring that holds the `budget`-th pixel, which
    the blocks' ring counts tell, are not passed on; they cannot be among the nearest.
    """
    keys = ["sample_id", "image_id"]
    store = _Store(region, keys, block)
    offers = seeds.select(*keys, "y", "x", F.lit(0).cast("long").alias("dist")).distinct()
    names, schema = [x.name for x in store.spark.createDataFrame([], store.schema).schema], store.schema

    def relax(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [_relaxed(row, block) for row in frame.itertuples(index=False)]
            kept = [list(row[:4]) + found for row, found in zip(frame.itertuples(index=False), kept) if found]
            yield pd.DataFrame(kept, columns=names)

    while True:
        to_block = _blocks(offers, block).groupBy(*store.at).agg(
            F.collect_list(F.struct("y", "x", "dist")).alias("offers")
        )
        work = grows(store.blocks).join(to_block, store.at)
        if store.round:
            work = work.join(grows(store.latest("dist")), store.at, "left")
        else:
            work = work.withColumn("dist", F.lit(None).cast("array<long>"))
        work = work.select(
            *store.at, "ys", "xs", "dist", F.col("offers.y").alias("oy"), F.col("offers.x").alias("ox"),
            F.col("offers.dist").alias("od"),
        )
        if not store.add(work.mapInPandas(relax, schema)):
            break
        border = store.last_border()
        if budget is not None:
            border = border.join(_far_limits(store, budget), keys, "left").filter(
                F.col("_far").isNull() | (F.col("dist") < F.col("_far"))
            )
        out = F.explode(F.array(*[
            F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"))
            for dy, dx in STEPS
        ]))
        offers = border.select(*keys, "y", "x", "dist", out.alias("to")).filter(
            (F.floor(F.col("to.y") / block) != F.floor(F.col("y") / block))
            | (F.floor(F.col("to.x") / block) != F.floor(F.col("x") / block))
        ).groupBy(*keys, F.col("to.y").alias("y"), F.col("to.x").alias("x")).agg(
            (F.min("dist") + 1).alias("dist")
        )
    both = store.blocks.join(grows(store.latest("dist")), store.at)
    pixels = both.select(*keys, F.explode(F.arrays_zip("ys", "xs", "dist")).alias("_p"))
    return pixels.select(
        *keys, F.col("_p.ys").alias("y"), F.col("_p.xs").alias("x"), F.col("_p.dist").alias("dist")
    ).filter(F.col("dist") < FAR)


def _relaxed(row, block: int) -> list | None:
    """Version columns of a block after its offers, or None if none of them is nearer."""
    ys, xs = np.asarray(row.ys, np.int64), np.asarray(row.xs, np.int64)
    known = np.full(len(ys), FAR, np.int64) if row.dist is None else np.asarray(row.dist, np.int64)
    y0, x0 = ys.min(), xs.min()
    height, width = int(ys.max() - y0) + 1, int(xs.max() - x0) + 1
    offered = np.full((height, width), FAR, np.int64)
    oy, ox = np.asarray(row.oy, np.int64) - y0, np.asarray(row.ox, np.int64) - x0
    inside = (oy >= 0) & (oy < height) & (ox >= 0) & (ox < width)
    np.minimum.at(offered, (oy[inside], ox[inside]), np.asarray(row.od, np.int64)[inside])
    start = np.minimum(known, offered[ys - y0, xs - x0])
    if np.array_equal(start, known):
        return None
    dist = _local_distance(ys, xs, start)
    edge = np.isin(ys % block, (0, block - 1)) | np.isin(xs % block, (0, block - 1))
    nearer = np.flatnonzero(edge & (dist < known))
    border = [{"y": int(ys[i]), "x": int(xs[i]), "dist": int(dist[i])} for i in nearer]
    rings, counts = np.unique(dist[dist < FAR], return_counts=True)
    per_ring = [{"ring": int(r), "n": int(n)} for r, n in zip(rings, counts)]
    return [int(counts.sum()), dist.tolist(), per_ring, border]


def grow(region: DataFrame, seeds: DataFrame, budget: int, block: int = BLOCK) -> DataFrame:
    """The `budget` region pixels nearest each seed through the region, ties by (y, x)."""
    reached = path_distance(region, seeds, budget, block)
    return take_lowest(
        reached, ["sample_id", "image_id"], F.col("dist"), [F.col("y"), F.col("x")], F.lit(budget)
    )


def regions(
    labelled: DataFrame, keys: Sequence[str] = ("image_id",), min_area: int = 16
) -> DataFrame:
    """Area, bounding box, centroid and exposed edges per component; specks are dropped."""
    keys = list(keys)
    pixel = [*keys, "y", "x"]
    out = F.explode(F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in STEPS
        if dy + dx > 0
    ]))
    # Every pixel has four edges; an edge shared with a pixel of the mask is not exposed. 4-adjacent
    # mask pixels always share a component, so touches are counted per pixel in one shuffle, and those
    # of a pair both at its lower or right pixel.
    touches = labelled.select(*keys, out.alias("to")).select(
        *keys, "to.y", "to.x", F.lit(None).cast("long").alias("component"), F.lit(2).alias("touch")
    )
    seen = labelled.select(*pixel, "component", F.lit(0).alias("touch")).unionByName(touches)
    per_pixel = seen.groupBy(*pixel).agg(
        F.max("component").alias("component"), F.sum("touch").alias("touches")
    ).filter(F.col("component").isNotNull())
    return (
        per_pixel.groupBy(*keys, "component")
        .agg(
            F.count(F.lit(1)).alias("area"),
            F.min("y").alias("y_min"), F.max("y").alias("y_max"),
            F.min("x").alias("x_min"), F.max("x").alias("x_max"),
            F.avg("y").alias("y_mean"), F.avg("x").alias("x_mean"),
            F.sum(4 - F.col("touches")).alias("exposed"),
        )
        .filter(F.col("area") >= min_area)
    )
