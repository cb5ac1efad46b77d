"""Similarity selection from clicked examples, on pixels and on any vector table.

A sample is a row (sample_id, image_id, y, x, positive). Every positive sample is resolved alone
and the results are united, so a further positive can only add pixels.
"""

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import dot, norm, ordered_values, rms_difference
from ..plans.ordered import take_lowest
from ..plans.sizing import is_empty
from ..plans.skew import salted_join, scene_join
from ..schema import PIXEL_KEY, UNLABELED
from ..session import cut
from . import regions
from .scoring import resize_field

# The sampling window, its ordering, and the warning share.
WINDOW_RADIUS = 2
MAX_SAMPLE = (2 * WINDOW_RADIUS + 1) ** 2
SOURCES = ("image", "sam")
LEVELS = ("fine", "mid", "deep")
LARGE_SHARE = 0.40
NORM_FLOOR = 1e-8

NEGATIVES_AT_ONCE = 256  # compared with a pixel in one row
PIVOTS, RINGS, LIST_PART = 64, 16, 1024  # inverted lists of examples
CHORD_SLACK = 1e-6  # more than the rounding of a chord
FIRST_ROWS = 4  # times k, the closest rows that meet the negatives first
CLOSE = 1e-12  # more than the rounding of a vector's distance to itself
CELL_PIVOTS, CELL_REACHES = 4, 64


def clamp_sample_size(n: int) -> int:
    return min(MAX_SAMPLE, max(1, int(n)))


def offsets(n: int) -> list[tuple[int, int]]:
    """The first `n` window offsets, nearest first, then by row and column."""
    reach = range(-WINDOW_RADIUS, WINDOW_RADIUS + 1)
    ordered = sorted((dy * dy + dx * dx, dy, dx) for dy in reach for dx in reach)
    return [(dy, dx) for _, dy, dx in ordered[:clamp_sample_size(n)]]


def place_samples(samples: DataFrame, scenes: DataFrame) -> DataFrame:
    """Round clicks to pixels and clamp them into their scene."""
    sized = samples.join(
        scenes.select("image_id", "height", "width"), "image_id"
    )

    def inside(c: str, limit: str) -> Column:
        at = F.bround(F.col(c).cast("double")).cast("int")
        return F.least(F.greatest(at, F.lit(0)), F.col(limit) - 1)

    return sized.withColumn("y", inside("y", "height")).withColumn(
        "x", inside("x", "width")
    ).drop("height", "width")


def _neighbours(samples: DataFrame, n: int) -> DataFrame:
    near = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets(n)
    ]))
    return samples.withColumn("o", near).select(
        "sample_id", "image_id", "positive",
        F.col("y").alias("sy"), F.col("x").alias("sx"),
        (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
    )


def reference(norm_px: DataFrame, samples: DataFrame, n: int = 1) -> DataFrame:
    """Mean normalised bands of the valid pixels among the `n` window pixels of each sample.

    Without a valid one, the clicked pixel's own values are used.
    """
    wanted = _neighbours(samples, n)
    hits = norm_px.select(*PIXEL_KEY, "valid", "norm").join(wanted, PIXEL_KEY)
    own = (F.col("y") == F.col("sy")) & (F.col("x") == F.col("sx"))
    keys = ["sample_id", "image_id", "positive", "sy", "sx"]
    per_band = hits.select(*keys, "valid", own.alias("own"), F.posexplode("norm")).groupBy(
        *keys, "pos"
    ).agg(
        F.coalesce(
            F.avg(F.when(F.col("valid"), F.col("col"))), F.max(F.when(F.col("own"), F.col("col")))
        ).alias("v")
    )
    return per_band.groupBy(*keys).agg(ordered_values("pos", "v").alias("ref")).withColumnsRenamed(
        {"sy": "y", "sx": "x"}
    )


def spectral_field(norm_px: DataFrame, refs: DataFrame) -> DataFrame:
    """RMS band difference of every pixel to every sample of its scene."""
    wanted = refs.select("sample_id", "image_id", "positive", "ref")
    return norm_px.select(*PIXEL_KEY, "valid", "norm").join(wanted, "image_id").select(
        "sample_id", "positive", *PIXEL_KEY, "valid", rms_difference("norm", "ref").alias("d")
    )


def contested_field(norm_px: DataFrame, refs: DataFrame, tolerance: float) -> DataFrame:
    """Positive fields within tolerance, with `d_neg`, the least distance to a negative.

    The negatives of a scene travel to its pixels in bundles of bounded size, and only pixels
    within tolerance of a positive sample meet them. Where no scene has a second bundle, a row has
    met all its negatives at once and nothing is grouped.
    """
    # Samples and bundles both read them; their pixels are scaled and looked up once.
    refs = cut(refs)
    order = Window.partitionBy("image_id").orderBy("sample_id")
    bundles = (
        refs.filter(~F.col("positive"))
        .withColumn("_bundle", F.floor((F.row_number().over(order) - 1) / NEGATIVES_AT_ONCE))
        .groupBy("image_id", "_bundle").agg(F.collect_list("ref").alias("negatives"))
    )
    wanted = refs.filter("positive").select("sample_id", "image_id", "positive", "ref")
    within = (
        norm_px.select(*PIXEL_KEY, "valid", "norm").filter("valid").join(wanted, "image_id")
        .withColumn("d", rms_difference("norm", "ref"))
        .filter(F.col("d") <= tolerance)
    )
    d_neg = F.array_min(F.transform("negatives", lambda r: rms_difference(F.col("norm"), r)))
    columns = ["sample_id", *PIXEL_KEY, "positive", "valid", "d", "d_neg"]
    met = within.join(bundles, "image_id", "left").withColumn("d_neg", d_neg).select(*columns)
    if is_empty(bundles.filter("_bundle > 0")):
        return met
    return met.groupBy("sample_id", *PIXEL_KEY).agg(
        F.first("positive").alias("positive"), F.first("valid").alias("valid"),
        F.first("d").alias("d"), F.min("d_neg").alias("d_neg"),
    )


def center_unit(features: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """`unit`: vectors minus the mean vector of their scene, at unit length."""
    keys = list(keys)
    if not keys:
        return _center_all(features)
    dims = features.select(*keys, F.posexplode("vec").alias("i", "v"))
    means = dims.groupBy(*keys, "i").agg(F.avg("v").alias("m"))
    mean = means.groupBy(*keys).agg(ordered_values("i", "m").alias("mean"))
    return _unit(salted_join(features, mean, keys, ["vec"], "inner")).drop("mean")


def _unit(features: DataFrame) -> DataFrame:
    centred = F.array(F.zip_with("vec", "mean", lambda v, m: v - m))
    # One-element transforms bind the centred vector and its length; as columns they would be put
    # into the last lambda, and the length be taken anew for every component.
    bound = F.transform(centred, lambda c: F.get(F.transform(
        F.array(F.greatest(norm(c), F.lit(NORM_FLOOR))), lambda length: F.transform(c, lambda v: v / length)
    ), F.lit(0)))
    return features.withColumn("unit", F.get(bound, F.lit(0)))


def _center_all(features: DataFrame) -> DataFrame:
    """One mean for the whole table: a single short vector, sent along as a constant."""
    dims = features.select(F.posexplode("vec").alias("i", "v"))
    means = dims.groupBy("i").agg(F.avg("v").alias("m"))
    mean = means.agg(ordered_values("i", "m").alias("mean")).first()["mean"]
    constant = F.lit([float(v) for v in mean]).cast("array<double>")
    return _unit(features.withColumn("mean", constant)).drop("mean")


def cell_of(samples: DataFrame, shape: DataFrame) -> DataFrame:
    """Grid cell of each sample by proportional scaling; `shape` has gh, gw, height, width."""
    sized = samples.join(
        shape.select("image_id", "gh", "gw", "height", "width"), "image_id"
    )

    def cell(c: str, extent: str, cells: str) -> Column:
        at = (F.col(c) / F.col(extent) * F.col(cells)).cast("int")
        return F.least(F.greatest(at, F.lit(0)), F.col(cells) - 1)

    return sized.select(
        "sample_id", "image_id", "positive",
        cell("y", "height", "gh").alias("y"), cell("x", "width", "gw").alias("x"),
    )


def cosine_field(
    unit: DataFrame, samples: DataFrame, shape: DataFrame, n: int = 1
) -> DataFrame:
    """Cosine distance of every grid cell `(image_id, gy, gx, unit)` to every sample."""
    cells = unit.select("image_id", F.col("gy").alias("y"), F.col("gx").alias("x"), "unit")
    wanted = _neighbours(cell_of(samples, shape), n)
    hits = cells.join(wanted, PIXEL_KEY)
    keys = ["sample_id", "image_id", "positive"]
    refs = (
        hits.select(*keys, F.posexplode("unit"))
        .groupBy(*keys, "pos").agg(F.avg("col").alias("v"))
        .groupBy(*keys).agg(ordered_values("pos", "v").alias("mean"))
        .withColumn("length", F.greatest(norm("mean"), F.lit(NORM_FLOOR)))
        .withColumn("ref", F.transform("mean", lambda v: v / F.col("length")))
        .select(*keys, "ref")
    )
    return scene_join(unit, refs, ["gy", "gx"]).select(
        *keys, "gy", "gx", (1.0 - dot("ref", "unit")).alias("d")
    )


def upsample_fields(fields: DataFrame, shape: DataFrame) -> DataFrame:
    """Lift distance fields (not features) from the grid to pixels."""
    keys = ("sample_id", "positive", "image_id")
    ids = fields.select(*keys).distinct()
    sized = ids.join(shape, "image_id")
    return resize_field(fields.withColumnRenamed("d", "v"), sized, keys)


def match(fields: DataFrame, samples: DataFrame, tolerance: float) -> DataFrame:
    """Pixels each positive sample selects: within tolerance, valid, and nearer to the sample
    than to every negative. The clicked pixel is always in.
    """
    within = fields.filter(F.col("positive") & F.col("valid") & (F.col("d") <= tolerance))
    if "d_neg" not in fields.columns:
        negative = fields.filter(~F.col("positive")).groupBy(*PIXEL_KEY).agg(
            F.min("d").alias("d_neg")
        )
        within = within.join(negative, PIXEL_KEY, "left")
    chosen = within.filter(
        F.col("d_neg").isNull() | (F.col("d") < F.col("d_neg"))
    ).select("sample_id", *PIXEL_KEY)
    seeds = samples.filter("positive").select("sample_id", *PIXEL_KEY)
    return chosen.unionByName(seeds).distinct()


def nearest(mask: DataFrame, samples: DataFrame, budget: int) -> DataFrame:
    """The `budget` selected pixels nearest each sample by straight line, ties by (y, x).

    Pixels are counted in rings around the click; only the ring the budget ends in is sorted.
    """
    seeds = samples.select("sample_id", "image_id", F.col("y").alias("sy"), F.col("x").alias("sx"))
    dy = (F.col("y") - F.col("sy")).cast("long")
    dx = (F.col("x") - F.col("sx")).cast("long")
    placed = mask.join(seeds, ["sample_id", "image_id"]).withColumn(
        "d2", dy * dy + dx * dx
    )
    return take_lowest(
        placed, ["sample_id", "image_id"], F.floor(F.sqrt("d2")),
        [F.col("d2"), F.col("y"), F.col("x")], F.lit(budget),
    ).drop("sy", "sx")


@dataclass
class Selection:
    """Selected pixels and a one-row DataFrame of counts."""

    pixels: DataFrame
    stats: DataFrame


def check_options(
    tolerance: float, sample_size: int, budget: int | None, source: str, level: str
) -> None:
    # The wording of the option errors.
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)):
        raise ValueError("A numeric tolerance is required")
    if not isinstance(sample_size, int):
        raise ValueError("sample_size must be an integer")
    if budget is not None and not isinstance(budget, int):
        raise ValueError("max_pixels must be an integer or null")
    if budget is not None and budget <= 0:
        raise ValueError("max_pixels must be positive")
    if source not in SOURCES:
        raise ValueError(f"Unknown wand source: {source}")
    if level not in LEVELS:
        raise ValueError(f"Unknown feature level: {level}")


def select(
    norm_px: DataFrame,
    samples: DataFrame,
    scenes: DataFrame,
    tolerance: float,
    sample_size: int = 1,
    budget: int | None = None,
    is_global: bool = False,
    protect: DataFrame | None = None,
    source: str = "image",
    level: str = "fine",
    features: DataFrame | None = None,
    fields: DataFrame | None = None,
) -> Selection:
    """Resolve every positive sample alone, unite the results, then withhold protected labels.

    `features(image_id, level, gy, gx, vec, gh, gw)` feeds the embedding source. `fields` replaces
    the distance altogether (any `(sample_id, positive, image_id, y, x, valid, d)`).
    """
    check_options(tolerance, sample_size, budget, source, level)
    samples = place_samples(samples, scenes)
    if not samples.filter("positive").take(1):
        raise ValueError("No samples given")
    size = clamp_sample_size(sample_size)
    if fields is None and source == "image":
        refs = reference(norm_px, samples, size)
        fields = contested_field(norm_px, refs, tolerance)
    elif fields is None:
        if features is None:
            raise ValueError("The embedding source needs features")
        grid = features.filter(F.col("level") == level)
        shape = grid.select("image_id", "gh", "gw").distinct().join(
            scenes.select("image_id", "height", "width"), "image_id"
        )
        coarse = cosine_field(center_unit(grid), samples, shape, size)
        fields = upsample_fields(coarse, shape).join(
            norm_px.select(*PIXEL_KEY, "valid"), PIXEL_KEY
        )
    # Read by the region, the budget and the counts: kept once, in the shared folder.
    matched = cut(match(fields, samples, tolerance))
    seeds = samples.filter("positive").select("sample_id", *PIXEL_KEY)
    region = matched if is_global else regions.region_of(matched, seeds)
    if budget is None:
        kept = region
    elif is_global:
        kept = nearest(region, seeds, budget)
    else:
        kept = regions.grow(region, seeds, budget)
    return _finish(kept, region, seeds, protect, norm_px, budget)


def _finish(
    kept: DataFrame,
    region: DataFrame,
    seeds: DataFrame,
    protect: DataFrame | None,
    px: DataFrame,
    budget: int | None,
) -> Selection:
    """Unite, protect, count. Labelled pixels conduct the fill and are withheld only here."""
    united = kept.select(*PIXEL_KEY).distinct()
    if protect is None:
        pixels = united
        withheld = united.limit(0)
    else:
        drawn = protect.filter(F.col("label") != UNLABELED).select(*PIXEL_KEY)
        pixels = united.join(drawn, PIXEL_KEY, "left_anti")
        withheld = united.join(drawn, PIXEL_KEY, "left_semi")
    per_sample = region.groupBy("sample_id").count()
    over = F.lit(False) if budget is None else F.coalesce(F.max("count") > budget, F.lit(False))
    # Every clicked pixel is selected, so the scenes of the clicks are the scenes of the selection.
    clicked = seeds.select("image_id").distinct()
    valid = px.join(clicked, "image_id", "left_semi").agg(
        F.count_if("valid").alias("valid")
    )
    parts = [
        pixels.agg(F.count(F.lit(1)).alias("count")),
        region.select(*PIXEL_KEY).distinct().agg(F.count(F.lit(1)).alias("available")),
        withheld.agg(F.count(F.lit(1)).alias("protected")),
        per_sample.agg(over.alias("capped")),
        valid,
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    stats = rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumn(
        "large", F.col("count") > LARGE_SHARE * F.col("valid")
    )
    return Selection(pixels, stats)


def edges(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    """Boundary of a selection: `inner` pixels miss a 4-neighbour, `outer` pixels touch it."""
    steps = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))
        for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))
    ]))
    own = mask.select(*PIXEL_KEY).distinct()
    reach = own.withColumn("s", steps).select(
        "image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")
    )
    # One shuffle: a pixel that receives four touches from selected neighbours is interior.
    touched = reach.withColumn("own", F.lit(0)).unionByName(own.withColumn("own", F.lit(1)))
    seen = touched.groupBy(*PIXEL_KEY).agg(
        F.max("own").alias("own"), F.count_if(F.col("own") == 0).alias("touches")
    )
    shape = scenes.select("image_id", "height", "width")
    inside = seen.join(shape, "image_id").filter(
        F.col("y").between(0, F.col("height") - 1) & F.col("x").between(0, F.col("width") - 1)
    )
    side = F.when(F.col("own") == 0, "outer").when(F.col("touches") < 4, "inner")
    return inside.withColumn("edge", side).filter(F.col("edge").isNotNull()).select(
        *PIXEL_KEY, "edge"
    )


def example_lists(examples: DataFrame, key: str) -> tuple[DataFrame, Column, Column]:
    """Inverted lists of examples `(key, positive, unit)`, a written table: `(lists, pivots, directory)`.

    Pivots are the examples with the least hashes; every example belongs to its nearest pivot, in
    rings by its chord to it. Neighbouring rings share a shelf until it holds LIST_PART examples; a
    larger one is cut into parts, the rows of `lists`. `directory` names the rings with their least
    and greatest chord, their shelf and its number of parts.
    Pivots and directory are constants of at most PIVOTS and 2 x PIVOTS x RINGS entries, whatever
    the number of examples.
    """
    chosen = examples.select("unit", key).orderBy(F.xxhash64(key), key, "unit").limit(PIVOTS)
    pivots = chosen.agg(F.array_sort(F.collect_list("unit")).alias("pivots")).scalar()
    placed = cut(
        examples.withColumn("_pivots", pivots)
        .withColumn("_chords", chords("unit", "_pivots"))
        .withColumn("chord", F.array_min("_chords"))
        .withColumn("list", (F.array_position("_chords", F.col("chord")) - 1).cast("int"))
        .withColumn("ring", F.floor(F.col("chord") * (RINGS / 2.0)).cast("int"))
        .drop("_pivots", "_chords")
    )
    ring = ["positive", "list", "ring"]
    # At most 2 x PIVOTS x RINGS rows are numbered here.
    along = Window.partitionBy("positive").orderBy("list", "ring")
    before = F.coalesce(F.sum("count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on_shelf = F.sum("count").over(Window.partitionBy("positive", "shelf"))
    rings = placed.groupBy(*ring).agg(
        F.min("chord").alias("low"), F.max("chord").alias("high"), F.count(F.lit(1)).alias("count"),
    ).withColumn("shelf", F.floor(before / LIST_PART).cast("int")).withColumn(
        "parts", F.ceil(on_shelf / LIST_PART).cast("int"))
    entry = F.struct(*ring, "low", "high", "shelf", "parts")
    directory = rings.agg(F.array_sort(F.collect_list(entry)).alias("rings")).scalar()
    # Shelves and parts are constants too, so that a hot ring is not gathered to cut it.
    own = F.filter("_rings", lambda e: (
        (e["positive"] == F.col("positive")) & (e["list"] == F.col("list")) & (e["ring"] == F.col("ring"))))
    lists = (
        placed.withColumn("_rings", directory)
        .withColumn("_own", F.get(own, F.lit(0)))
        .withColumn("shelf", F.col("_own.shelf"))
        .withColumn("part", F.pmod(F.xxhash64(key, "unit"), F.col("_own.parts")).cast("int"))
        .groupBy("positive", "shelf", "part").agg(F.collect_list("unit").alias("refs"))
    )
    return cut(lists), pivots, directory


def chords(vec: str, refs: str) -> Column:
    """Straight-line distances of unit vectors, the metric form of the cosine distance."""
    return F.transform(refs, lambda ref: F.sqrt(F.greatest(2.0 - 2.0 * dot(ref, F.col(vec)), F.lit(0.0))))


def nearest_example(
    rows: DataFrame, lists: DataFrame, directory: Column, positive: bool, reach: Column | None,
    key: str, name: str,
) -> DataFrame:
    """`(key, <name>, compared)`: least cosine distance to the examples of one sign, exactly.

    By the triangle inequality a ring can hold the nearest only if the row's chord to its pivot,
    less or more than the ring's chords by at most the row's reach, allows it. The reach is the
    nearest upper bound of any ring, and `reach` where one is given. Rows carry `chords`.
    """
    upper = F.array_min(F.transform(
        "rings", lambda e: F.get("chords", e["list"]) + e["low"]))
    limit = upper if reach is None else F.least(upper, reach)

    def possible(e: Column) -> Column:
        at = F.get("chords", e["list"])
        return F.greatest(at - e["high"], e["low"] - at) <= F.col("limit") + CHORD_SLACK

    wanted = (
        rows.withColumn("rings", directory)
        .withColumn("rings", F.filter("rings", lambda e: e["positive"] == F.lit(positive)))
        .withColumn("limit", limit)
        .select(key, "unit", F.explode(F.array_distinct(F.transform(
            F.filter("rings", possible), lambda e: F.struct(e["shelf"].alias("shelf"), e["parts"].alias("parts")),
        ))).alias("e"))
        .select(key, "unit", F.lit(positive).alias("positive"), "e.shelf",
                F.explode(F.sequence(F.lit(0), F.col("e.parts") - 1)).alias("part"))
    )
    met = wanted.join(lists, ["positive", "shelf", "part"])
    least = F.array_min(F.transform("refs", lambda ref: 1.0 - dot(ref, F.col("unit"))))
    return met.groupBy(key).agg(
        F.min(least).alias(name), F.sum(F.size("refs")).cast("long").alias("compared"))


def close_rows(
    rows: DataFrame, examples: DataFrame, pivots: Column, bound: float, key: str
) -> DataFrame:
    """`(key, d, compared)`: rows within a small cosine distance of an example, and the least one, exactly.

    Vectors so near have nearly equal products with any unit vector. Those with a few pivots, cut into
    steps many times as wide as the bound, are the key of a join; an example stands in every cell that
    its near rows can fall into. Repeated examples count once.
    """
    reach = math.sqrt(max(2.0 * bound, 0.0)) + CHORD_SLACK
    marks = [f"_{j}" for j in range(CELL_PIVOTS)]

    def marked(df: DataFrame) -> DataFrame:
        held = df.withColumn("_pivots", F.slice(pivots, 1, CELL_PIVOTS))
        return held.withColumns({
            m: F.coalesce(dot(F.get("_pivots", j), "unit"), F.lit(0.0)) for j, m in enumerate(marks)
        }).drop("_pivots")

    def cell(sides: tuple[int, ...]) -> Column:
        return F.xxhash64(*[F.floor((F.col(m) + s * reach) / (CELL_REACHES * reach)) for m, s in zip(marks, sides)])

    corners = F.array_distinct(F.array(*[cell(sides) for sides in product((-1, 1), repeat=CELL_PIVOTS)]))
    placed = marked(examples.select("unit").distinct()).select(F.col("unit").alias("ref"), F.explode(corners).alias("cell"))
    met = marked(rows).withColumn("cell", cell((0,) * CELL_PIVOTS)).join(placed, "cell")
    return met.select(key, (1.0 - dot("ref", "unit")).alias("d")).groupBy(key).agg(
        F.min("d").alias("d"), F.count(F.lit(1)).alias("compared")
    ).filter(F.col("d") <= bound)


def similar(
    vectors: DataFrame,
    samples: DataFrame,
    tolerance: float,
    k: int | None = None,
    key: str = "vec_id",
) -> DataFrame:
    """Search any vector table from positive and negative examples `(vec_id, positive)`.

    Cosine distance on centred vectors; a row matches its nearest positive within tolerance when
    that beats every negative. `k` keeps the closest rows: a distributed top-k, merged per task.
    Results are exact: `d`, `d_neg` (null without negatives) and `compared`, the number of examples
    a row was compared with. Keys of `vectors` are unique; a vector with a null component or one
    that is not finite matches nothing and is no example.

    Examples are rows too, no farther from themselves than rounding. With `k` and no fewer positives,
    rows at that distance are looked up first, by a join; they pass if no negative is as near. Only if
    these are fewer than `k` does every row meet the lists of examples.
    """
    sound = vectors.filter(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    unit = center_unit(sound, keys=())
    examples = cut(unit.join(samples.select(key, "positive"), key).select(key, "positive", "unit"))
    lists, pivots, directory = example_lists(examples, key)
    rows = unit.select(key, "unit")

    def with_chords(some: DataFrame) -> DataFrame:
        return some.withColumn("pivots", pivots).withColumn("chords", chords("unit", "pivots")).drop("pivots")

    def passed(near: DataFrame) -> DataFrame:
        against = nearest_example(
            with_chords(rows.join(near.select(key), key, "left_semi")), lists, directory, False, None, key, "d_neg"
        ).withColumnRenamed("compared", "_more")
        return near.join(against, key, "left").filter(
            F.col("d_neg").isNull() | (F.col("d") < F.col("d_neg"))
        ).withColumn("compared", F.col("compared") + F.coalesce("_more", F.lit(0))).drop("_more")

    if k is None:
        return sound.join(passed(_within(with_chords(rows), lists, directory, tolerance, key)), key)
    positives, negatives = (examples.filter(F.col("positive") == sign) for sign in (True, False))
    bound = min(tolerance, CLOSE)
    if positives.count() >= k:
        near = cut(close_rows(rows, positives, pivots, bound, key))
        # A negative that is not found here is farther than the bound, and so than the row's positive.
        beside = close_rows(rows.join(near.select(key), key, "left_semi"), negatives, pivots, bound, key).select(
            key, F.col("d").alias("_beside"))
        kept = near.join(beside, key, "left").filter(F.col("_beside").isNull() | (F.col("d") < F.col("_beside")))
        best = cut(kept.drop("_beside").orderBy("d", key).limit(k))
        if best.count() == k:
            return sound.join(passed(best), key)
    near = _within(with_chords(rows), lists, directory, tolerance, key)
    best = cut(passed(cut(near.orderBy("d", key).limit(FIRST_ROWS * k))))
    judged = (best if best.count() >= k else passed(near)).orderBy("d", key).limit(k)
    return sound.join(judged, key)


def _within(
    rows: DataFrame, lists: DataFrame, directory: Column, tolerance: float, key: str
) -> DataFrame:
    """Every row within tolerance of a positive example, written once."""
    reach = F.lit(math.sqrt(max(2.0 * tolerance, 0.0)))
    return cut(nearest_example(rows, lists, directory, True, reach, key, "d").filter(F.col("d") <= tolerance))
