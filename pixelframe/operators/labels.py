"""Label repair, edits as rows, replay, diffs, undo and merging with predictions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import BUCKET, lag_in_chunks, marks_around
from ..plans.skew import scene_join
from ..schema import BACKGROUND, EXCLUDED, PIXEL_KEY, TARGET, UNLABELED

EDIT_CHUNK = 1024
RUN = ["image_id", "seq", "value", "y", "x0", "x1"]


def repair_mask(masks: DataFrame, column: str = "raw_label") -> DataFrame:
    """`label`: unusable values become unlabelled before the integer cast.

    A declared nodata is ignored on purpose; only values a byte cannot hold, and the reserved
    exclusion marker, are repaired.
    """
    v = F.col(column)
    unusable = v.isNull() | F.isnan(v) | (v < 0) | (v > 255) | (v == EXCLUDED)
    return masks.withColumn("label", F.when(unusable, UNLABELED).otherwise(v.cast("int")))


def collapse_labels(rows: DataFrame) -> DataFrame:
    """`target` for training and losses: 0, 1, or 255; `mask` also keeps the exclusions."""
    label = F.col("label")
    mask = F.when(~F.col("valid"), EXCLUDED).otherwise(label)
    target = (
        F.when(mask.isin(EXCLUDED, UNLABELED), UNLABELED)
        .when(mask != TARGET, BACKGROUND)
        .otherwise(TARGET)
    )
    return rows.withColumn("mask", mask).withColumn("target", target)


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("image_id").agg(
        F.count_if(F.col("label") != UNLABELED).alias("labeled_px")
    )


# ---- expanding edits into pixels ----


def _span(low: Column, high: Column) -> Column:
    """Integers low..high, none when the range is empty."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def stamp(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixels of each disc edit: integer positions within `r` of the pointer, inside the scene."""
    sized = scene_join(edits, scenes.select("image_id", "height", "width"), ["cx", "cy"])
    return stamp_sized(sized)


def stamp_sized(sized: DataFrame) -> DataFrame:
    """`stamp` for edits that already carry `height` and `width` (also fit for streams)."""
    def box(centre: str, limit: str) -> Column:
        low = F.greatest(F.lit(0), F.floor(F.col(centre) - F.col("r")).cast("int"))
        high = F.least(F.col(limit) - 1, F.ceil(F.col(centre) + F.col("r")).cast("int"))
        return _span(low, high)

    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return (
        sized.withColumn("y", F.explode(box("cy", "height")))
        .withColumn("x", F.explode(box("cx", "width")))
        .filter(dx * dx + dy * dy <= F.col("r") * F.col("r"))
        .drop("height", "width")
    )


def stamp_runs(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """The pixels of `stamp` as runs `(image_id, seq, value, y, x0, x1)`, one per row of a disc."""
    sized = scene_join(edits, scenes.select("image_id", "height", "width"), ["cx", "cy"])
    low = F.greatest(F.lit(0), F.floor(F.col("cy") - F.col("r")).cast("int"))
    high = F.least(F.col("height") - 1, F.ceil(F.col("cy") + F.col("r")).cast("int"))
    dy, rr = F.col("y") - F.col("cy"), F.col("r") * F.col("r")
    inside = lambda x: (x - F.col("cx")) * (x - F.col("cx")) + dy * dy <= rr
    half = F.sqrt(F.greatest(rr - dy * dy, F.lit(0.0)))
    # The root may be off by a rounding: the disc's own test decides at either end.
    left, right = F.ceil(F.col("cx") - half), F.floor(F.col("cx") + half)
    left = F.when(inside(left - 1), left - 1).when(inside(left), left).otherwise(left + 1)
    right = F.when(inside(right + 1), right + 1).when(inside(right), right).otherwise(right - 1)
    return (
        sized.withColumn("y", F.explode(_span(low, high)))
        .withColumn("x0", F.greatest(F.lit(0), left.cast("int")))
        .withColumn("x1", F.least(F.col("width") - 1, right.cast("int")))
        .filter("x0 <= x1").select(*_run_columns())
    )


def _run_columns() -> list[Column]:
    return [F.col(c).cast("long") if c == "seq" else F.col(c) for c in RUN]


def stroke_runs(strokes: DataFrame, scenes: DataFrame) -> DataFrame:
    """Runs of strokes `(image_id, stroke_id, pos, cx, cy, r, seq, value)`: all stamps of a stroke are one edit."""
    marks = stroke_points(strokes).drop("cx", "cy").withColumnsRenamed({"sx": "cx", "sy": "cy"})
    return stamp_runs(marks, scenes).distinct()


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """Runs of pixel edits `(image_id, y, x, seq, value)`, such as a committed selection's."""
    line = ["image_id", "seq", "value", "y"]
    rank = F.row_number().over(Window.partitionBy(*line).orderBy("x"))
    islands = pixels.select(*line, "x").distinct().withColumn("_run", F.col("x") - rank)
    runs = islands.groupBy(*line, "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    return runs.select(*_run_columns())


def stroke_points(strokes: DataFrame) -> DataFrame:
    """Stamp centres along each stroke, at most half a radius apart.

    The first position is stamped alone; every later one closes an evenly divided segment.
    """
    moved = lag_in_chunks(
        strokes, ["stroke_id"], F.floor(F.col("pos") / EDIT_CHUNK), "pos",
        {"cx": "_px", "cy": "_py"},
    )
    from_x, from_y = F.coalesce("_px", "cx"), F.coalesce("_py", "cy")
    dx, dy = F.col("cx") - from_x, F.col("cy") - from_y
    steps = F.greatest(
        F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / (F.col("r") / 2)).cast("int")
    )
    return (
        moved.withColumn("steps", steps)
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.col("steps"))))
        .withColumn("sx", from_x + dx * F.col("step") / F.col("steps"))
        .withColumn("sy", from_y + dy * F.col("step") / F.col("steps"))
        .drop("_px", "_py")
    )


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """Closed polygon edges (ax, ay) -> (bx, by); polygons under three vertices are dropped.

    Vertices are numbered from 0 per polygon. Each vertex meets its successor by an equality join
    on (polygon, vertex), so one huge polygon is spread over tasks.
    """
    key = ["image_id", "poly_id"]
    sizes = polygons.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3")
    starts = polygons.select(*key, "vertex", F.col("vx").alias("ax"), F.col("vy").alias("ay"))
    inner = polygons.filter("vertex > 0").withColumn("vertex", F.col("vertex") - 1)
    closing = polygons.filter("vertex = 0").join(sizes, key).withColumn(
        "vertex", (F.col("_n") - 1).cast("int")
    )
    ends = inner.select(*key, "vertex", "vx", "vy").unionByName(
        closing.select(*key, "vertex", "vx", "vy")
    ).select(*key, "vertex", F.col("vx").alias("bx"), F.col("vy").alias("by"))
    return starts.join(ends, [*key, "vertex"]).join(sizes.select(*key), key, "left_semi")


def fill_polygons(polygons: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixels of `polygon_runs`."""
    runs = polygon_runs(polygons, scenes)
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def polygon_runs(polygons: DataFrame, scenes: DataFrame) -> DataFrame:
    """Even-odd fill at row centres as runs `(image_id, poly_id, y, x0, x1)`: spans rounded half up, clipped to the scene.

    Crossings are paired per scanline, so the sorted group is one scanline of one polygon; spans of
    sorted crossings, rounded monotonously, do not overlap.
    """
    key = ["image_id", "poly_id", "y"]
    shape = scenes.select("image_id", "height", "width")
    edges = scene_join(polygon_edges(polygons), shape, ["ax", "ay"])
    top, bottom = F.least("ay", "by"), F.greatest("ay", "by")
    rows = _span(
        F.greatest(F.lit(0), F.floor(top).cast("int") - 1),
        F.least(F.col("height") - 1, F.ceil(bottom).cast("int")),
    )
    yc = F.col("y") + 0.5
    crossing = F.col("ax") + (yc - F.col("ay")) / (F.col("by") - F.col("ay")) * (
        F.col("bx") - F.col("ax")
    )
    hits = (
        edges.withColumn("y", F.explode(rows))
        .filter((F.col("ay") <= yc) != (F.col("by") <= yc))
        .select(*key, "width", crossing.alias("cross"))
    )
    order = Window.partitionBy(*key).orderBy("cross")
    paired = (
        hits.withColumn("k", F.row_number().over(order))
        .withColumn("next", F.lead("cross").over(order))
        .filter("k % 2 = 1 and next is not null")
        .select(*key, "width", F.col("cross").alias("x1"), F.col("next").alias("x2"))
    )
    half_up = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    low = F.greatest(F.lit(0), half_up("x1"))
    high = F.least(F.col("width") - 1, half_up("x2") - 1)
    return paired.select(*key, low.alias("x0"), high.alias("x1")).filter("x0 <= x1")


# ---- replay ----


def _clears(edits: DataFrame) -> DataFrame:
    return edits.filter(F.col("kind") == "clear")


def pixel_edits(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixels touched by disc edits; an edit touches a pixel once however often it stamps it."""
    discs = stamp(edits.filter(F.col("kind") == "stamp"), scenes)
    return discs.select(*PIXEL_KEY, "seq", "value").distinct()


def replay(pixels: DataFrame, clears: DataFrame) -> DataFrame:
    """Final labels of `pixels(image_id, y, x, seq, value)`: the last write wins.

    A clear is one row per scene, `clears(image_id, seq)`; writes before the scene's last clear
    are dropped by comparison instead of exploding the clear to pixels. Returns labelled pixels.
    """
    wiped = clears.groupBy("image_id").agg(F.max("seq").alias("_wiped"))
    last = pixels.groupBy(*PIXEL_KEY).agg(
        F.max("seq").alias("seq"), F.max_by("value", "seq").alias("label")
    )
    kept = scene_join(last, wiped, ["y", "x"], "left").filter(
        F.col("_wiped").isNull() | (F.col("seq") > F.col("_wiped"))
    )
    return kept.filter(F.col("label") != UNLABELED).select(*PIXEL_KEY, "label", "seq")


def _eras(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """Edits with the clears around them: an era is what lies between `after` and `wiped`, null at either end of the log.

    `opened` and `closed` tell whether the era begins and ends in the edit's chunk of the log. Edits
    carry the size of their scene and are clustered by scene and chunk.
    """
    shape = scenes.select("image_id", "height", "width")
    sized = scene_join(edits.select("image_id", "seq", "kind", "value", "cx", "cy", "r"), shape, ["seq"])
    around = marks_around(
        sized, ["image_id"], F.floor(F.col("seq") / EDIT_CHUNK), "seq", F.col("kind") == "clear", "after", "wiped"
    )
    start = F.col(BUCKET) * EDIT_CHUNK
    return (
        around.filter("kind = 'stamp'")
        .withColumn("opened", F.coalesce(F.col("after") >= start, F.lit(False)))
        .withColumn("closed", F.coalesce(F.col("wiped") < start + EDIT_CHUNK, F.lit(False)))
    )


def _writes(eras: DataFrame) -> DataFrame:
    """Writes of pixels with `prev`, the value written before; `head` and `tail` are an era's ends in its chunk.

    Pixels are sorted where their edits lie: nothing is shuffled.
    """
    here = Window.partitionBy("image_id", BUCKET, "y", "x").orderBy("seq")
    discs = stamp_sized(eras).select(*PIXEL_KEY, BUCKET, "seq", "value", "after", "wiped", "opened", "closed")
    return (
        discs.withColumn("_before", F.lag(F.struct("seq", "value")).over(here))
        .withColumn("_next", F.lead("seq").over(here))
        .withColumn("head", F.col("_before").isNull() | F.coalesce(F.col("_before.seq") < F.col("after"), F.lit(False)))
        .withColumn("tail", F.col("_next").isNull() | F.coalesce(F.col("_next") > F.col("wiped"), F.lit(False)))
        .withColumn("prev", F.when(F.col("head"), F.lit(UNLABELED)).otherwise(F.col("_before.value")))
        .drop("_before", "_next")
    )


def _steps(writes: DataFrame, written: Column, wiped: Column) -> DataFrame:
    """`(image_id, y, x, seq, prev, value)` of `written` rows that change their pixel, and of the clears of `wiped` ones."""
    unlabeled = F.lit(UNLABELED)
    change = F.when(written & (F.col("value") != F.col("prev")), F.struct("seq", "prev", "value"))
    wipe = F.when(wiped & F.col("wiped").isNotNull() & (F.col("value") != unlabeled), F.struct(
        F.col("wiped").alias("seq"), F.col("value").alias("prev"), unlabeled.alias("value")))
    steps = F.explode(F.array_compact(F.array(change, wipe)))
    return writes.select(*PIXEL_KEY, steps.alias("_s")).select(*PIXEL_KEY, "_s.seq", "_s.prev", "_s.value")


def _diff(edits: DataFrame, scenes: DataFrame, writes: bool) -> DataFrame:
    eras = _eras(edits, scenes)
    first, last = F.col("head") & ~F.col("opened"), F.col("tail") & ~F.col("closed")
    within = _steps(_writes(eras), F.lit(writes) & ~first, F.col("tail") & F.col("closed"))
    # Of eras that reach over chunks, a pixel's first and last write of each chunk meet.
    ends = _writes(eras.filter(~F.col("opened") | ~F.col("closed"))).withColumn("first", first).withColumn("last", last)
    era = Window.partitionBy(*PIXEL_KEY, "after").orderBy("seq")
    across = (
        ends.filter("first or last").select(*PIXEL_KEY, "seq", "value", "after", "wiped", "first", "last")
        .withColumn("prev", F.coalesce(F.lag("value").over(era), F.lit(UNLABELED)))
        .withColumn("last", F.col("last") & F.lead("seq").over(era).isNull())
    )
    return within.unionByName(_steps(across, F.lit(writes) & F.col("first"), F.col("last")))


def edit_diff(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pixels each edit really changes, with their previous value.

    Between two clears of a scene a pixel starts unlabelled, so the previous value is the last
    write of the same era. A clear changes every pixel its era left labelled.
    """
    return _diff(edits, scenes, True)


def wiped_pixels(edits: DataFrame, scenes: DataFrame) -> DataFrame:
    """The rows of `edit_diff` that belong to clears."""
    return _diff(edits, scenes, False)


# ---- merging with predictions and selections ----


def adopt(labels: DataFrame, pred: DataFrame) -> DataFrame:
    """Fill unlabelled pixels from the prediction; painted pixels win, also on invalid ground."""
    drawn = labels.select(*PIXEL_KEY, "label")
    guess = pred.select(*PIXEL_KEY, "cls")
    label = F.coalesce("label", F.lit(UNLABELED))
    cls = F.coalesce("cls", F.lit(UNLABELED))
    filled = (label == UNLABELED) & (cls != UNLABELED)
    return drawn.join(guess, PIXEL_KEY, "full_outer").select(
        *PIXEL_KEY,
        F.when(filled, cls).otherwise(label).alias("label"),
        filled.alias("filled"),
    )


def merge_export(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Prediction, overwritten by every user label, then voided where the pixel is invalid.

    `pred` carries `cls` and `valid` for every pixel of the scene.
    """
    joined = pred.select(*PIXEL_KEY, "cls", "valid").join(
        labels.select(*PIXEL_KEY, "label"), PIXEL_KEY, "left"
    )
    drawn = F.coalesce("label", F.lit(UNLABELED)) != UNLABELED
    merged = (
        F.when(~F.col("valid"), UNLABELED).when(drawn, F.col("label")).otherwise(F.col("cls"))
    )
    return joined.select(*PIXEL_KEY, merged.alias("mask"))


def commit_selection(selection: DataFrame, seq: int, value: int) -> DataFrame:
    """A selection as one edit: pixel rows that `replay` takes beside disc edits."""
    return selection.select(*PIXEL_KEY).distinct().withColumn(
        "seq", F.lit(seq).cast("long")
    ).withColumn("value", F.lit(value))
