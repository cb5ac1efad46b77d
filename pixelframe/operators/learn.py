"""A pixel classifier on Spark ML, and self-training around it."""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import ordered_values
from ..schema import PIXEL_KEY, TARGET
from ..session import cut
from .evaluate import (
    CLASS_WEIGHTS, CONFIDENCE, LAMBDA_PSEUDO, confusion, metric_columns, pseudo_labels,
)
from .labels import collapse_labels
from .monitor import PATIENCE, STABLE_IOU, ramp_value


def neighbourhood_means(norm_px: DataFrame, radius: int = 1) -> DataFrame:
    """Append the window mean of every band to `norm`, over valid pixels.

    Each pixel is sent to the windows it lies in and averaged there, combined map-side.
    """
    reach = range(-radius, radius + 1)
    steps = F.explode(F.array(*[
        F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in reach for dx in reach
    ]))
    spread = norm_px.filter("valid").select(
        *PIXEL_KEY, "norm", steps.alias("s")
    ).select(
        "image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"),
        F.posexplode("norm").alias("b", "v"),
    )
    means = spread.groupBy(*PIXEL_KEY, "b").agg(F.avg("v").alias("m")).groupBy(*PIXEL_KEY).agg(
        ordered_values("b", "m").alias("means")
    )
    none = F.transform("norm", lambda _: F.lit(0.0))
    return norm_px.join(means, PIXEL_KEY, "left").withColumn(
        "norm", F.concat("norm", F.coalesce("means", none))
    ).drop("means")


@dataclass
class PixelModel:
    """A fitted classifier; `apply` adds `probs` and `cls` (index = label value)."""

    model: LogisticRegressionModel

    def apply(self, norm_px: DataFrame) -> DataFrame:
        scored = self.model.transform(
            norm_px.withColumn("features", array_to_vector("norm"))
        ).withColumn("probs", vector_to_array("probability"))
        best = F.array_position("probs", F.array_max("probs")) - 1
        cls = F.when(F.col("valid"), best).otherwise(255).cast("int")
        return scored.withColumn("cls", cls).drop(
            "features", "rawPrediction", "probability", "prediction"
        )


def training_rows(norm_px: DataFrame, labels: DataFrame, split: DataFrame, scenes: DataFrame):
    """Labelled, valid pixels of training scenes with `target` and class weight `w`."""
    training = scenes.join(split.filter("role = 'training'"), "name", "left_semi").select("image_id")
    drawn = norm_px.join(training, "image_id", "left_semi").join(
        labels.select(*PIXEL_KEY, "label"), PIXEL_KEY
    )
    rows = collapse_labels(drawn).filter(F.col("target").isin(0, 1))
    weight = F.when(F.col("target") == TARGET, CLASS_WEIGHTS[0]).otherwise(CLASS_WEIGHTS[1])
    return rows.withColumn("w", weight)


def _fit(rows: DataFrame, iterations: int) -> PixelModel:
    prepared = rows.select(
        array_to_vector("norm").alias("features"), F.col("target").cast("double").alias("target"), "w"
    )
    learner = LogisticRegression(
        featuresCol="features", labelCol="target", weightCol="w", maxIter=iterations,
        family="multinomial",
    )
    return PixelModel(learner.fit(prepared))


def fit_pixels(
    norm_px: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    scenes: DataFrame,
    iterations: int = 50,
) -> PixelModel:
    """Supervised fit on training scenes, target weighted 2 : 1."""
    rows = training_rows(norm_px, labels, split, scenes)
    if not rows.take(1):
        raise ValueError("No labeled images to train on")
    return _fit(rows, iterations)


@dataclass
class SelfTraining:
    model: PixelModel
    log: list[dict]


def self_train(
    norm_px: DataFrame,
    labels: DataFrame,
    split: DataFrame,
    scenes: DataFrame,
    rounds: int = 5,
    threshold: float = CONFIDENCE,
    stable_iou: float = STABLE_IOU,
    patience: int = PATIENCE,
    iterations: int = 50,
) -> SelfTraining:
    """Supervised rounds until the target IoU is stable, then confident pseudo-labels join in.

    The gate latches and the pseudo-label weight follows the ramp. The log holds one small
    dict per round; pixels stay distributed, and pseudo-labels are cut to the checkpoint folder so
    rounds do not stack up lineage.
    """
    rounds = max(1, int(rounds))
    drawn = cut(training_rows(norm_px, labels, split, scenes))
    if not drawn.take(1):
        raise ValueError("No labeled images to train on")
    training = scenes.join(split.filter("role = 'training'"), "name", "left_semi").select("image_id")
    known = labels.select(*PIXEL_KEY, F.col("label"))
    unlabeled = (
        norm_px.filter("valid").join(training, "image_id", "left_semi")
        .join(known, PIXEL_KEY, "left")
        .withColumn("label", F.coalesce("label", F.lit(255)))
        .filter("label = 255")
        .withColumn("mask", F.col("label"))
    )
    rows, log, gate, streak = drawn, [], None, 0
    spark = norm_px.sparkSession
    for number in range(1, rounds + 1):
        weight = 0.0
        if gate is not None:
            weight = spark.range(1).select(
                ramp_value(F.lit(number), F.lit(gate), F.lit(rounds)).alias("r")
            ).first()["r"]
            guessed = pseudo_labels(model.apply(unlabeled), threshold).select(
                "norm", F.col("pseudo").alias("target"), F.lit(weight * LAMBDA_PSEUDO).alias("w")
            )
            rows = cut(drawn.select("norm", "target", "w").unionByName(guessed))
        model = _fit(rows, iterations)
        judged = model.apply(drawn.withColumn("label", F.col("target")))
        iou = confusion(judged, []).select(metric_columns()["iou"].alias("iou")).first()["iou"]
        log.append({"epoch": number, "epochs": rounds, "iou": iou, "ramp": weight})
        if gate is None:
            streak = streak + 1 if iou is not None and iou >= stable_iou else 0
            gate = number + 1 if streak >= patience else None
    return SelfTraining(model, log)
