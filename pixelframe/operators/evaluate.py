"""Segmentation accuracy, its aggregation over scenes, and the training losses."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, mean_square_difference
from ..plans.ordered import running_totals
from ..schema import PIXEL_KEY, ROLES, TARGET, UNLABELED

COUNTS = ["tp", "fp", "fn", "tn"]
METRICS = ["iou", "precision", "recall", "f1", "accuracy"]

# Outcomes of one scene.
SCORED, BACKGROUND_ONLY, NOT_LABELED = "scored", "background only", "unlabeled"

# Loss weights and thresholds.
CLASS_WEIGHTS = (2.0, 1.0)
LAMBDA_DICE = 0.5
LAMBDA_LOVASZ = 1.0
LAMBDA_PSEUDO = 0.5
LAMBDA_CONSISTENCY = 1.0
CONFIDENCE = 0.92
GAP_WARNING = 0.15


def match_labels(labels: DataFrame, pred: DataFrame, how: str = "inner") -> DataFrame:
    """Labels beside predictions, pixel by pixel."""
    return labels.join(pred, PIXEL_KEY, how)


def confusion(rows: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Confusion counts over labelled, valid rows of (`label`, `cls`, `valid`).

    One conditional count per cell, combined map-side: a scene of any size shuffles one row per
    task.
    """
    scored = (F.col("label") != UNLABELED) & F.col("valid")
    truth, hit = F.col("label") == TARGET, F.col("cls") == TARGET
    return rows.groupBy(*keys).agg(
        F.count_if(scored & truth & hit).alias("tp"),
        F.count_if(scored & ~truth & hit).alias("fp"),
        F.count_if(scored & truth & ~hit).alias("fn"),
        F.count_if(scored & ~truth & ~hit).alias("tn"),
    )


def metric_columns(prefix: str = "") -> dict[str, Column]:
    """Unrounded metrics from the four counts; null where the denominator is zero."""
    tp, fp, fn, tn = (F.col(prefix + c) for c in COUNTS)
    return {
        "iou": F.try_divide(tp, tp + fp + fn),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
    }


def derive(counts: DataFrame) -> DataFrame:
    return counts.withColumns(metric_columns())


def status() -> Column:
    drawn = sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0]))
    return (
        F.when(drawn == 0, NOT_LABELED)
        .when(F.col("tp") + F.col("fn") == 0, BACKGROUND_ONLY)
        .otherwise(SCORED)
    )


def score_images(
    rows: DataFrame, scenes: DataFrame, split: DataFrame, keys: Sequence[str] = ("image_id",)
) -> DataFrame:
    """One row per scene: counts, metrics, status, pixel tallies, name and role."""
    tallies = {
        "status": status(),
        "labeled_px": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
        "gt_target_px": F.col("tp") + F.col("fn"),
        "pred_target_px": F.col("tp") + F.col("fp"),
    }
    scored = derive(confusion(rows, keys)).withColumns(tallies)
    return scored.join(scenes.select(*keys, "name"), list(keys)).join(
        split.select("name", "role"), "name"
    )


def _pooled() -> list[Column]:
    used = F.col("status") != NOT_LABELED
    sums = [F.sum(F.when(used, F.col(c)).otherwise(0)).alias(c) for c in COUNTS]
    means = [F.avg(F.when(used, F.col(m))).alias(f"macro_{m}") for m in METRICS]
    return [
        F.count(F.lit(1)).alias("images"),
        F.count_if(used).alias("scored_images"),
        F.count(F.when(used, F.col("iou"))).alias("macro_images"),
        *sums,
        *means,
    ]


def _finish(pooled: DataFrame) -> DataFrame:
    micro = {f"micro_{k}": v for k, v in metric_columns().items()}
    return pooled.withColumns(micro).withColumn(
        "scoreable", F.col("tp") + F.col("fp") + F.col("fn") > 0
    )


def aggregate(scores: DataFrame, keys: Sequence[str] = ("role",)) -> DataFrame:
    """Pooled (micro) and averaged (macro) metrics per set."""
    return _finish(scores.groupBy(*keys).agg(*_pooled()))


def report(scores: DataFrame, total: bool = False) -> DataFrame:
    """Both sets, also when one is empty; `total` adds a row over all scenes (role null)."""
    pooled = scores.rollup("role").agg(F.grouping("role").alias("_all"), *_pooled())
    pooled = pooled.filter(F.lit(total) | (F.col("_all") == 0)).drop("_all")
    spark = scores.sparkSession
    sets = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    both = sets.join(pooled.filter(F.col("role").isNotNull()), "role", "left")
    counted = ["images", "scored_images", "macro_images", *COUNTS]
    both = both.fillna(0, subset=counted)
    if total:
        both = both.unionByName(pooled.filter(F.col("role").isNull()))
    return _finish(both)


def gap(report_rows: DataFrame, warn: float = GAP_WARNING) -> DataFrame:
    """Training minus validation pooled IoU; null if either is; flagged above `warn`."""
    by_role = {r: F.max(F.when(F.col("role") == r, F.col("micro_iou"))) for r in ROLES}
    out = report_rows.agg((by_role["training"] - by_role["validation"]).alias("gap"))
    return out.withColumn("flagged", F.coalesce(F.col("gap") > warn, F.lit(False)))


def sort_report(scores: DataFrame, key: str = "iou", ascending: bool = True) -> DataFrame:
    """Sorted rows, nulls last in both directions, ties by name."""
    order = F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()
    return scores.orderBy(order, "name")


def target_iou(rows: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Live IoU: null without target ground truth, even with false positives."""
    counts = confusion(rows, keys)
    live = F.when(F.col("tp") + F.col("fn") > 0, metric_columns()["iou"])
    return counts.select(*keys, live.alias("iou"))


def repool(scores: DataFrame, removed: DataFrame) -> DataFrame:
    """The set summary after scenes are gone, from the remaining rows."""
    return aggregate(scores.join(removed.select("name"), "name", "left_anti"))


def mask_iou(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("image_id",), threshold: float = 0.99
) -> DataFrame:
    """Agreement of two masks given as rows of selected pixels; two empty masks agree fully."""
    left = a.select(*PIXEL_KEY).distinct().withColumn("in_a", F.lit(1))
    right = b.select(*PIXEL_KEY).distinct().withColumn("in_b", F.lit(1))
    joined = left.join(right, PIXEL_KEY, "full_outer")
    counts = joined.groupBy(*keys).agg(
        F.count(F.col("in_a") + F.col("in_b")).alias("inter"), F.count(F.lit(1)).alias("uni")
    )
    iou = F.coalesce(F.try_divide("inter", "uni"), F.lit(1.0))
    return counts.withColumn("iou", iou).withColumn("agrees", F.col("iou") > threshold)


# ---- losses: rows carry `label` (collapsed to 0/1/255) and `probs` ----


def _labeled() -> Column:
    return F.col("label").isin(0, 1)


def _log_loss(index: Column) -> Column:
    return -F.ln(F.get("probs", index))


def ce(
    rows: DataFrame,
    keys: Sequence[str] = ("image_id",),
    weights: Sequence[float] | None = CLASS_WEIGHTS,
) -> DataFrame:
    """Cross-entropy over labelled pixels; `weights=None` divides by the pixel count."""
    return rows.groupBy(*keys).agg(_ce(weights).alias("ce"))


def _ce(weights: Sequence[float] | None = CLASS_WEIGHTS) -> Column:
    loss = F.when(_labeled(), _log_loss(F.col("label")))
    if weights is None:
        top, bottom = F.coalesce(F.sum(loss), F.lit(0.0)), F.greatest(F.count(loss), F.lit(1))
    else:
        weight = F.when(_labeled(), F.get(F.array(*[F.lit(float(w)) for w in weights]),
                                          F.col("label")))
        top = F.coalesce(F.sum(weight * loss), F.lit(0.0))
        bottom = F.greatest(F.coalesce(F.sum(weight), F.lit(0.0)), F.lit(1e-6))
    return top / bottom


def dice(
    rows: DataFrame, keys: Sequence[str] = ("image_id",), classes: int = 2
) -> DataFrame:
    """1 - 2 sum(pt) / sum(p + t) per class over labelled pixels, averaged over the classes.

    A class without a true pixel contributes 0.
    """
    return rows.groupBy(*keys).agg(_dice(classes).alias("dice"))


def _dice(classes: int = 2) -> Column:
    terms = []
    for c in range(classes):
        p = F.when(_labeled(), F.get("probs", c))
        t = F.when(_labeled(), (F.col("label") == c).cast("double"))
        loss = 1 - F.try_divide(2 * F.sum(p * t), F.sum(p + t))
        terms.append(F.when(F.coalesce(F.sum(t), F.lit(0.0)) > 0, loss).otherwise(0.0))
    return sum(terms[1:], terms[0]) / classes


def lovasz(
    rows: DataFrame,
    keys: Sequence[str] = ("image_id",),
    classes: int = 2,
    buckets: int = 64,
) -> DataFrame:
    """Lovasz-Softmax, averaged over the classes present.

    Pixels with equal error telescope into one step of the Jaccard curve, so they are counted
    first; the running sums over the remaining distinct errors are split over buckets, whose edges
    come from a quantile sketch, so that errors in a narrow range are spread as well.
    """
    keys = list(keys)
    per_class = F.explode(F.array(*[
        F.struct(
            F.lit(c).alias("cls"),
            (F.col("label") == c).cast("long").alias("fg"),
            F.abs((F.col("label") == c).cast("double") - F.get("probs", c)).alias("err"),
        )
        for c in range(classes)
    ]))
    steps = (
        rows.filter(_labeled())
        .select(*keys, per_class.alias("e"))
        .groupBy(*keys, "e.cls", "e.err")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("e.fg").alias("fg"))
    )
    totals = steps.groupBy(*keys, "cls").agg(F.sum("fg").alias("gts"))
    cuts = [k / buckets for k in range(1, buckets)]
    edges = steps.groupBy(*keys, "cls").agg(
        F.percentile_approx("err", F.lit(cuts), 16 * buckets).alias("_edges")
    )
    place = -F.size(F.filter("_edges", lambda e: e < F.col("err")))
    placed = steps.join(edges, [*keys, "cls"]).withColumn("_place", place).drop("_edges")
    walked = running_totals(
        placed, [*keys, "cls"], F.col("_place"), [F.desc("err")],
        {"upto": F.col("n"), "fg_upto": F.col("fg")},
    ).join(totals.filter("gts > 0"), [*keys, "cls"])

    def jaccard(count: Column, hits: Column) -> Column:
        gts = F.col("gts")
        return 1 - (gts - hits) / (gts + count - hits)

    after = jaccard(F.col("upto"), F.col("fg_upto"))
    before = jaccard(F.col("upto") - F.col("n"), F.col("fg_upto") - F.col("fg"))
    return (
        walked.groupBy(*keys, "cls")
        .agg(F.sum(F.col("err") * (after - before)).alias("loss"))
        .groupBy(*keys)
        .agg(F.avg("loss").alias("lovasz"))
    )


def _unlabeled() -> Column:
    """By `mask`, in which nodata is excluded rather than unlabelled."""
    return F.col("mask") == UNLABELED


def pseudo_labels(rows: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Unlabelled pixels the model is sure about, with the winning class as `pseudo`.

    Rows carry `mask` as `collapse_labels` gives it, so a pixel without data is never taken.
    """
    return rows.filter(_unlabeled() & (F.array_max("probs") > threshold)).withColumn(
        "pseudo", argmax("probs")
    )


def consistency(rows: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean over unlabelled pixels of the squared difference of two views' probabilities.

    Rows carry `mask`, `weak_probs` and `strong_probs`; no unlabelled pixel gives 0.
    """
    return rows.groupBy(*keys).agg(_consistency().alias("cons"))


def _consistency() -> Column:
    diff = mean_square_difference("strong_probs", "weak_probs")
    return F.coalesce(F.avg(F.when(_unlabeled(), diff)), F.lit(0.0))


def pseudo_ce(
    rows: DataFrame, keys: Sequence[str] = ("image_id",), threshold: float = CONFIDENCE
) -> DataFrame:
    """Unweighted cross-entropy of the strong view against the weak view's sure guesses."""
    return rows.groupBy(*keys).agg(_pseudo_ce(threshold).alias("pseudo"))


def _pseudo_ce(threshold: float) -> Column:
    sure = _unlabeled() & (F.array_max("weak_probs") > threshold)
    loss = F.when(sure, -F.ln(F.get("strong_probs", argmax("weak_probs"))))
    return F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))


def total_loss(
    rows: DataFrame,
    ramp: float | Column,
    keys: Sequence[str] = ("image_id",),
    threshold: float = CONFIDENCE,
) -> DataFrame:
    """Supervised losses plus ramped pseudo-label and consistency terms.

    Rows carry `label`, `mask`, `strong_probs` (the supervised prediction) and `weak_probs`. The
    supervised terms are 0 where nothing is labelled.
    """
    keys = list(keys)
    supervised = rows.withColumn("probs", F.col("strong_probs"))
    parts = (
        supervised.groupBy(*keys)
        .agg(_ce().alias("ce"), _dice().alias("dice"),
             _pseudo_ce(threshold).alias("pseudo"), _consistency().alias("cons"))
        .join(lovasz(supervised, keys), keys, "left")
        .fillna(0.0, subset=["lovasz"])
    )
    ramp = ramp if isinstance(ramp, Column) else F.lit(float(ramp))
    supervised_sum = (
        F.col("ce") + LAMBDA_DICE * F.col("dice") + LAMBDA_LOVASZ * F.col("lovasz")
    )
    unsupervised = LAMBDA_PSEUDO * F.col("pseudo") + LAMBDA_CONSISTENCY * F.col("cons")
    return parts.withColumn("total", supervised_sum + ramp * unsupervised)
