"""Training-set construction: epoch order, geometric and photometric views, multi-patch mixes.

Every random choice is a hash of (seed, epoch, purpose, patch key), so a result does not depend on
partitioning and a lost task is recomputed identically. Mixes are decided per patch and only move
*source coordinates*; pixel values are fetched once, by an equality join, at the end.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import between, integer_below, mixed, uniform
from ..plans.ordered import running_totals
from ..schema import EXCLUDED, PIXEL_KEY, TARGET, TRAIN_BATCH, UNLABELED
from ..session import cut
from .tiling import PATCH_KEY

# Probabilities and ranges of the augmentations.
P_FLIP = P_ROTATE = 0.5
P_NOISE, NOISE_STD = 0.8, (0.01, 0.05)
P_LIGHT, LIGHT_LIMIT = 0.8, 0.2
P_CHANNEL_DROP, MAX_CHANNELS_DROPPED = 0.15, 2
P_HOLES, MAX_HOLES, HOLE_SIDE = 0.5, 6, (4, 24)
P_MOSAIC = P_CUTMIX = P_COPY_PASTE = 0.2
CUTMIX_AREA = (0.05, 0.35)
CUTMIX_ASPECT = (0.5, 2.0)
DONOR_ATTEMPTS = 8

# Purpose numbers keep the choices of one patch apart.
(ORDER_IMAGE, ORDER_PATCH, FLIP_H, FLIP_V, ROTATE, ROTATE_BY, NOISE, NOISE_LEVEL,
 LIGHT, CONTRAST, BRIGHTNESS, DROP, DROP_COUNT, DROP_FIRST, DROP_SECOND, HOLES, HOLE_COUNT, HOLE_H,
 HOLE_W, HOLE_Y, HOLE_X, DONOR_Y, DONOR_X, MOSAIC, SPLIT_Y, SPLIT_X, CUTMIX, BOX_AREA, BOX_ASPECT,
 BOX_Y, BOX_X, PASTE, PASTE_H, PASTE_V, NOISE_SIZE, NOISE_ANGLE) = range(1, 37)
MOSAIC_SLOTS, CUTMIX_SLOT, PASTE_SLOT = (1, 2, 3), 4, 5


class Draws:
    """Random columns for one seed and epoch over the patch key."""

    def __init__(self, seed: int, epoch: int):
        self.head = (seed, epoch)

    def _parts(self, purpose: int, extra) -> tuple:
        return (*self.head, purpose, *[F.col(c) for c in PATCH_KEY], *extra)

    def u(self, purpose: int, *extra) -> Column:
        return uniform(*self._parts(purpose, extra))

    def span(self, low: float, high: float, purpose: int, *extra) -> Column:
        return between(low, high, *self._parts(purpose, extra))

    def below(self, bound, purpose: int, *extra) -> Column:
        return integer_below(bound, *self._parts(purpose, extra))


def epoch_order(
    patches: DataFrame, seed: int, epoch: int, batch: int = TRAIN_BATCH
) -> DataFrame:
    """Shuffle scenes per epoch and patches per scene; number batches inside each scene.

    Patches are ranked inside slices of their hash, so one huge scene is not sorted in one task.
    """
    keyed = patches.withColumn(
        "image_order", mixed(seed, epoch, ORDER_IMAGE, F.col("image_id"))
    ).withColumn("patch_order", mixed(seed, epoch, ORDER_PATCH, *[F.col(c) for c in PATCH_KEY]))
    placed = running_totals(
        keyed, ["image_id"], F.floor(F.col("patch_order") / (1 << 19)),
        [F.col("patch_order"), F.col("ty"), F.col("tx")], {"position": F.lit(1)},
    )
    return placed.withColumn(
        "batch", F.floor((F.col("position") - 1) / batch).cast("int")
    ).drop("patch_order")


def augment_weak(pixels: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """Flip and rotate patches by moving `(dy, dx)`; values and labels move together."""
    draw = Draws(seed, epoch)
    last = size - 1
    flip_h, flip_v = draw.u(FLIP_H) < P_FLIP, draw.u(FLIP_V) < P_FLIP
    turns = F.when(draw.u(ROTATE) < P_ROTATE, draw.below(4, ROTATE_BY)).otherwise(0)
    flipped = (
        pixels.withColumn("_turns", turns)
        .withColumn("_y", F.when(flip_v, last - F.col("dy")).otherwise(F.col("dy")))
        .withColumn("_x", F.when(flip_h, last - F.col("dx")).otherwise(F.col("dx")))
    )
    y, x, t = F.col("_y"), F.col("_x"), F.col("_turns")
    return (
        flipped.withColumn(
            "dy", F.when(t == 1, last - x).when(t == 2, last - y).when(t == 3, x).otherwise(y))
        .withColumn(
            "dx", F.when(t == 1, y).when(t == 2, last - x).when(t == 3, last - y).otherwise(x))
        .drop("_y", "_x", "_turns")
    )


def strong_plan(
    patches: DataFrame, size: int, channels: int, seed: int, epoch: int
) -> DataFrame:
    """Photometric choices per patch: noise level, light, dropped channels, holes.

    Made once per patch, so that pixels carry a few plain numbers instead of dozens of hashes.
    """
    draw = Draws(seed, epoch)

    def side(purpose: int, k: Column) -> Column:
        return F.least(
            F.lit(size), HOLE_SIDE[0] + draw.below(HOLE_SIDE[1] - HOLE_SIDE[0] + 1, purpose, k))

    def hole(k: Column) -> Column:
        height, width = side(HOLE_H, k), side(HOLE_W, k)
        return F.struct(
            draw.below(F.lit(size) - height + 1, HOLE_Y, k).alias("top"),
            draw.below(F.lit(size) - width + 1, HOLE_X, k).alias("left"),
            height.alias("height"), width.alias("width"),
        )

    first = draw.below(channels, DROP_FIRST)
    second = (first + 1 + draw.below(max(1, channels - 1), DROP_SECOND)) % channels
    two = draw.below(MAX_CHANNELS_DROPPED, DROP_COUNT) == 1
    dropped = F.when(two, F.array(first, second)).otherwise(F.array(first))
    none = F.array().cast("array<int>")
    count = F.when(draw.u(HOLES) < P_HOLES, draw.below(MAX_HOLES, HOLE_COUNT) + 1).otherwise(0)
    numbers = F.filter(F.sequence(F.lit(0), F.lit(MAX_HOLES - 1)), lambda k: k < F.col("_holes"))
    return (
        patches.select(*PATCH_KEY)
        .withColumn("noise_std", F.when(
            draw.u(NOISE) < P_NOISE, draw.span(*NOISE_STD, NOISE_LEVEL)))
        .withColumn("lit", draw.u(LIGHT) < P_LIGHT)
        .withColumn("contrast", 1 + draw.span(-LIGHT_LIMIT, LIGHT_LIMIT, CONTRAST))
        .withColumn("brightness", draw.span(-LIGHT_LIMIT, LIGHT_LIMIT, BRIGHTNESS))
        .withColumn("dropped", F.when(draw.u(DROP) < P_CHANNEL_DROP, dropped).otherwise(none))
        .withColumn("_holes", count)
        .withColumn("holes", F.transform(numbers, hole))
        .drop("_holes")
    )


def augment_strong(
    pixels: DataFrame, plan: DataFrame, channels: int, seed: int, epoch: int
) -> DataFrame:
    """Noise, light, dropped channels and holes on `norm`; the geometry stays as it is.

    `plan` is `strong_plan` of the patches. Noise is a normal number by the polar method, from the
    patch, the pixel's place in it and the band.
    """
    dy, dx = F.col("dy"), F.col("dx")
    draws = Draws(seed, epoch)

    def clip(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    def noise(band: int) -> Column:
        size, angle = (draws.u(purpose, dy, dx, band) for purpose in (NOISE_SIZE, NOISE_ANGLE))
        return F.sqrt(-2 * F.ln(1 - size)) * F.cos(2 * F.pi() * angle)

    holed = F.lit(False)
    for k in range(MAX_HOLES):
        h = F.get("holes", k)
        holed = holed | (
            h.isNotNull() & (dy >= h["top"]) & (dy < h["top"] + h["height"])
            & (dx >= h["left"]) & (dx < h["left"] + h["width"])
        )
    bands = []
    for b in range(channels):
        v = F.get("norm", b)
        v = F.when(F.col("noise_std").isNotNull(), clip(v + F.col("noise_std") * noise(b))).otherwise(v)
        v = F.when(F.col("lit"), clip(v * F.col("contrast") + F.col("brightness"))).otherwise(v)
        blank = F.array_contains("dropped", b) | holed
        bands.append(F.when(blank, 0.0).otherwise(v))
    planned = [c for c in plan.columns if c not in PATCH_KEY]
    return pixels.join(plan, PATCH_KEY).withColumn(
        "norm", F.array(*bands)
    ).drop(*planned)


# ---- donors ----


def label_integral(masks: DataFrame, scenes: DataFrame) -> DataFrame:
    """Summed-area table of labelled and target pixels over `(image_id, y, x, mask)` rows.

    Pixels of a scene without a row count as unlabelled. Two windows, one along rows and one along columns; neither holds more than one line.
    """
    labeled = ((F.col("mask") != UNLABELED) & (F.col("mask") != EXCLUDED)).cast("long")
    target = (F.col("mask") == TARGET).cast("long")
    span = (Window.unboundedPreceding, Window.currentRow)
    along_x = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(*span)
    along_y = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(*span)
    every = scenes.select(
        "image_id", "width", F.explode(F.expr("sequence(0, height - 1)")).alias("y")
    ).select("image_id", "y", F.explode(F.expr("sequence(0, width - 1)")).alias("x"))
    masks = every.join(masks.select(*PIXEL_KEY, "mask"), PIXEL_KEY, "left").fillna(
        UNLABELED, subset=["mask"]
    )
    rows = masks.select(
        *PIXEL_KEY, F.sum(labeled).over(along_x).alias("l"), F.sum(target).over(along_x).alias("t")
    )
    return rows.select(
        *PIXEL_KEY, F.sum("l").over(along_y).alias("l"), F.sum("t").over(along_y).alias("t")
    )


def window_label_stats(windows: DataFrame, integral: DataFrame, size: int) -> DataFrame:
    """`labeled_px` and `target_px` of any `size` window at (oy, ox): four lookups each."""
    keys = windows.columns
    corners = F.explode(F.array(*[
        F.struct((F.col("oy") + a * size - 1).alias("y"), (F.col("ox") + b * size - 1).alias("x"),
                 F.lit(1 if a == b else -1).alias("sign"))
        for a in (0, 1) for b in (0, 1)
    ]))
    looked = windows.select(*keys, corners.alias("c")).select(
        *keys, "c.y", "c.x", "c.sign"
    ).join(integral, PIXEL_KEY, "left")
    return looked.groupBy(*keys).agg(
        F.sum(F.col("sign") * F.coalesce("l", F.lit(0))).alias("labeled_px"),
        F.sum(F.col("sign") * F.coalesce("t", F.lit(0))).alias("target_px"),
    )


def donors(
    patches: DataFrame,
    scenes: DataFrame,
    size: int,
    slots: tuple[int, ...],
    seed: int,
    epoch: int,
    require: Column | None = None,
    integral: DataFrame | None = None,
) -> DataFrame:
    """Random off-grid windows of the same scene per patch and slot: `(oy, ox)`.

    `require` is a predicate over `labeled_px` and `target_px` of the candidate window; the first
    of eight candidates that passes is taken, a patch without one has no row.
    """
    draw = Draws(seed, epoch)
    shape = scenes.select("image_id", "height", "width")
    attempts = range(DONOR_ATTEMPTS if require is not None else 1)
    tries = F.explode(F.array(*[
        F.struct(F.lit(slot).alias("slot"), F.lit(k).alias("attempt"))
        for slot in slots for k in attempts
    ]))

    def start(extent: str, purpose: int) -> Column:
        room = F.col(extent) - size + 1
        return draw.below(room, purpose, F.col("slot"), F.col("attempt"))

    candidates = (
        patches.select(*PATCH_KEY).join(shape, "image_id")
        .withColumn("t", tries)
        .select(*PATCH_KEY, "height", "width", "t.slot", "t.attempt")
        .select(*PATCH_KEY, "slot", "attempt",
                start("height", DONOR_Y).alias("oy"), start("width", DONOR_X).alias("ox"))
    )
    if require is not None:
        candidates = window_label_stats(candidates, integral, size).filter(require)
    place = F.min_by(F.struct("oy", "ox"), "attempt")
    return candidates.groupBy(*PATCH_KEY, "slot").agg(place.alias("p")).select(
        *PATCH_KEY, "slot", "p.oy", "p.ox"
    )


def _with_donors(plan: DataFrame, found: DataFrame, slots: tuple[int, ...]) -> DataFrame:
    wide = found.groupBy(*PATCH_KEY).agg(*[
        F.max(F.when(F.col("slot") == s, F.struct("oy", "ox"))).alias(f"donor{s}") for s in slots
    ])
    return plan.join(wide, PATCH_KEY, "left")


# ---- mixes: columns on the patch plan ----


def mosaic(plan: DataFrame, found: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """Own top-left quadrant, three donors for the others, split in the middle half."""
    draw = Draws(seed, epoch)
    quarter = size // 4
    room = size - 2 * quarter + 1
    return (
        _with_donors(plan, found, MOSAIC_SLOTS)
        .withColumn("mosaic", draw.u(MOSAIC) < P_MOSAIC)
        .withColumn("split_y", quarter + draw.below(room, SPLIT_Y))
        .withColumn("split_x", quarter + draw.below(room, SPLIT_X))
    )


def cutmix(plan: DataFrame, found: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """A box of 5-35 % of the area from a donor, at the same coordinates."""
    draw = Draws(seed, epoch)
    area = draw.span(*CUTMIX_AREA, BOX_AREA) * (size * size)
    aspect = draw.span(*CUTMIX_ASPECT, BOX_ASPECT)

    def side(value: Column) -> Column:
        return F.least(F.lit(size), F.greatest(F.lit(1), F.rint(F.sqrt(value)).cast("int")))

    return (
        _with_donors(plan, found, (CUTMIX_SLOT,))
        .withColumn("cutmix", draw.u(CUTMIX) < P_CUTMIX)
        .withColumn("box_h", side(area / aspect))
        .withColumn("box_w", side(area * aspect))
        .withColumn("box_y", draw.below(F.lit(size) - F.col("box_h") + 1, BOX_Y))
        .withColumn("box_x", draw.below(F.lit(size) - F.col("box_w") + 1, BOX_X))
    )


def copy_paste(plan: DataFrame, found: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Target pixels of a donor, randomly flipped; never onto excluded ground."""
    draw = Draws(seed, epoch)
    return (
        _with_donors(plan, found, (PASTE_SLOT,))
        .withColumn("paste", draw.u(PASTE) < P_COPY_PASTE)
        .withColumn("paste_h", draw.u(PASTE_H) < 0.5)
        .withColumn("paste_v", draw.u(PASTE_V) < 0.5)
    )


def render(plan: DataFrame, px: DataFrame, size: int) -> DataFrame:
    """Pixels of planned patches with `norm` and `mask` fetched from their source positions.

    `px(image_id, y, x, norm, mask)` is dense. Mixes that the plan does not carry are skipped.
    """
    planned = set(plan.columns)
    side = F.sequence(F.lit(0), F.lit(size - 1))
    rows = plan.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side))
    dy, dx = F.col("dy"), F.col("dx")
    source = F.struct((F.col("ty") + dy).alias("y"), (F.col("tx") + dx).alias("x"))

    def at(donor: str) -> Column:
        place = F.col(donor)
        return F.struct((place["oy"] + dy).alias("y"), (place["ox"] + dx).alias("x"))

    if "mosaic" in planned:
        right, below = dx >= F.col("split_x"), dy >= F.col("split_y")
        for slot, quadrant in zip(MOSAIC_SLOTS, (right & ~below, ~right & below, right & below)):
            use = F.col("mosaic") & quadrant & F.col(f"donor{slot}").isNotNull()
            source = F.when(use, at(f"donor{slot}")).otherwise(source)
    if "cutmix" in planned:
        top, left = F.col("box_y"), F.col("box_x")
        boxed = (
            (dy >= top) & (dy < top + F.col("box_h")) & (dx >= left) & (dx < left + F.col("box_w"))
        )
        use = F.col("cutmix") & boxed & F.col(f"donor{CUTMIX_SLOT}").isNotNull()
        source = F.when(use, at(f"donor{CUTMIX_SLOT}")).otherwise(source)
    rows = rows.withColumn("_s", source)
    values = px.select(
        "image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), "norm", "mask"
    )
    key = ["image_id", "sy", "sx"]
    base = rows.withColumn("sy", F.col("_s.y")).withColumn("sx", F.col("_s.x"))
    out = [*PATCH_KEY, "dy", "dx", "sy", "sx", "norm", "mask"]
    if "paste" not in planned:
        return base.join(values, key).select(*out)

    donor = F.col(f"donor{PASTE_SLOT}")
    fy = F.when(F.col("paste_v"), size - 1 - dy).otherwise(dy)
    fx = F.when(F.col("paste_h"), size - 1 - dx).otherwise(dx)
    pasted = F.when(F.col("paste"), F.struct(
        (donor["oy"] + fy).alias("y"), (donor["ox"] + fx).alias("x")))
    # Only pixels that take something from a donor go through the second join.
    base = base.withColumn("_p", pasted).withColumn("_p", F.when(F.col("_p.y").isNotNull(), F.col("_p")))
    plain = base.filter(F.col("_p").isNull()).join(values, key).select(*out)
    own = base.filter(F.col("_p").isNotNull()).join(values, key).select(*out, "_p")
    donor_values = px.filter(F.col("mask") == TARGET).select(
        "image_id", F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("norm").alias("_pn")
    )
    placed = own.withColumn("_py", F.col("_p.y")).withColumn("_px", F.col("_p.x")).join(
        donor_values, ["image_id", "_py", "_px"], "left"
    )
    take = F.col("_pn").isNotNull() & (F.col("mask") != EXCLUDED)
    placed = placed.select(
        *PATCH_KEY, "dy", "dx",
        F.when(take, F.col("_py")).otherwise(F.col("sy")).alias("sy"),
        F.when(take, F.col("_px")).otherwise(F.col("sx")).alias("sx"),
        F.when(take, F.col("_pn")).otherwise(F.col("norm")).alias("norm"),
        F.when(take, F.lit(TARGET)).otherwise(F.col("mask")).alias("mask"),
    )
    return plain.unionByName(placed)


def compose(
    patches: DataFrame,
    px: DataFrame,
    scenes: DataFrame,
    size: int,
    seed: int,
    epoch: int,
    prefer_labeled: bool = False,
) -> DataFrame:
    """Mosaic, then cutmix, then copy-paste, each with its own probability.

    `prefer_labeled` (the warm-up) asks for labelled donors in the first two.
    """
    px = cut(px)  # read by the counts of windows, by the patches and by what is pasted
    integral = label_integral(px, scenes)
    require = F.col("labeled_px") > 0 if prefer_labeled else None
    if prefer_labeled:
        integral = cut(integral)  # looked up by both kinds of donor
    # Donors are one row per patch and slot; several mixes read them.
    mixing = cut(donors(
        patches, scenes, size, (*MOSAIC_SLOTS, CUTMIX_SLOT), seed, epoch, require, integral
    ))
    pasting = cut(donors(
        patches, scenes, size, (PASTE_SLOT,), seed, epoch, F.col("target_px") > 0, integral
    ))
    plan = mosaic(patches.select(*PATCH_KEY), mixing, size, seed, epoch)
    plan = cutmix(plan, mixing, size, seed, epoch)
    plan = copy_paste(plan, pasting, seed, epoch)
    return render(plan, px, size)
