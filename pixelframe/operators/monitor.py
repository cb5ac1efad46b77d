"""Run monitoring: stability gate, ramp, epoch summaries, save points and labelling rate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import LAMBDA_DICE, LAMBDA_LOVASZ

# The stability gate and the ramp.
STABLE_IOU = 0.70
PATIENCE = 3
RAMP_SHARE = 0.6
RAMP_MIN_EPOCHS = 5


def gate(
    epoch_log: DataFrame, threshold: float = STABLE_IOU, patience: int = PATIENCE
) -> DataFrame:
    """First epoch (1-based) with unsupervised losses per run, null while the gate is shut.

    The gate opens after `patience` consecutive epochs at or above the threshold. A good epoch
    votes for itself and the next ones; an epoch with all votes closes a streak. Votes combine
    map-side, so a run of any length needs no window. Of an epoch logged several times the least
    value counts, and a missing one is least.
    """
    worst = F.min(F.coalesce(F.col("iou"), F.lit(-1.0))).alias("iou")
    once = epoch_log.groupBy("run_id", "epoch").agg(worst)
    good = once.filter(F.col("iou") >= threshold)
    votes = good.select(
        "run_id",
        F.explode(F.sequence(F.col("epoch"), F.col("epoch") + (patience - 1))).alias("epoch"),
    ).groupBy("run_id", "epoch").agg(F.count(F.lit(1)).alias("votes"))
    opened = votes.filter(F.col("votes") >= patience).groupBy("run_id").agg(
        (F.min("epoch") + 1).alias("gate_epoch")
    )
    runs = epoch_log.groupBy("run_id").agg(F.max("epochs").alias("epochs"))
    return runs.join(opened, "run_id", "left")


def ramp_value(epoch: Column, gate_epoch: Column, epochs: Column) -> Column:
    """Weight of the unsupervised losses; all three are counted from 1.

    Zero-based: min(1, (e - g + 1) / max(5, round(0.6 (E - g)))) from the gate on.
    """
    zero_based_gate = gate_epoch - 1
    length = F.greatest(
        F.lit(RAMP_MIN_EPOCHS), F.bround(F.lit(RAMP_SHARE) * (epochs - zero_based_gate))
    )
    value = F.least(F.lit(1.0), (epoch - gate_epoch + 1) / length)
    return F.when(gate_epoch.isNull() | (epoch < gate_epoch), F.lit(0.0)).otherwise(value)


def ramp(epoch_log: DataFrame, **gate_options) -> DataFrame:
    gates = gate(epoch_log, **gate_options).select("run_id", "gate_epoch")
    value = ramp_value(F.col("epoch"), F.col("gate_epoch"), F.col("epochs"))
    return epoch_log.join(gates, "run_id").withColumn("ramp", value)


def epoch_summary(batch_log: DataFrame) -> DataFrame:
    """Mean batch losses and pooled IoU per run and epoch.

    Uses whichever of loss_sup, loss_dice, loss_lovasz, loss_pseudo, loss_cons are present; dice
    and lovasz are folded into the one supervised number.
    """
    present = set(batch_log.columns)
    sup = F.col("loss_sup")
    if "loss_dice" in present:
        sup = sup + LAMBDA_DICE * F.col("loss_dice")
    if "loss_lovasz" in present:
        sup = sup + LAMBDA_LOVASZ * F.col("loss_lovasz")
    batches = F.greatest(F.count(F.lit(1)), F.lit(1))
    means = [(F.sum(sup) / batches).alias("loss_sup")]
    for extra in ("loss_pseudo", "loss_cons"):
        if extra in present:
            means.append((F.sum(extra) / batches).alias(extra))
    return batch_log.groupBy("run_id", "epoch").agg(
        F.count(F.lit(1)).alias("batches"),
        *means,
        F.try_divide(F.sum("inter"), F.sum("uni")).alias("iou"),
    )


def save_points(edits: DataFrame, quiet: str = "1 second") -> DataFrame:
    """One save per burst of edits of a scene, `quiet` after its last edit (batch and stream)."""
    return (
        edits.groupBy("image_id", F.session_window("ts", quiet).alias("burst"))
        .agg(F.count(F.lit(1)).alias("edits"))
        .select("image_id", F.col("burst.end").alias("saved_at"), "edits")
    )


def label_rate(edits: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Edits per scene and tumbling or sliding window (batch and stream)."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        edits.groupBy("image_id", span.alias("w"))
        .agg(F.count(F.lit(1)).alias("edits"))
        .select("image_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits")
    )
