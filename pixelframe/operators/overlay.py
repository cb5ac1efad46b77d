"""Class colours over predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UNLABELED

OVERLAY_ALPHA = 160


def colorize(pred: DataFrame, classes: DataFrame, alpha: int = OVERLAY_ALPHA) -> DataFrame:
    """Red, green, blue and alpha per pixel from `classes(id, name, color)` with `#rrggbb` colours.

    Ids without a colour, and unlabelled pixels, stay fully transparent.
    """
    channels = {
        name: F.conv(F.substring("color", 2 + 2 * i, 2), 16, 10).cast("int").alias(name)
        for i, name in enumerate(("red", "green", "blue"))
    }
    palette = classes.filter(F.col("id") != UNLABELED).select(
        F.col("id").alias("cls"), *channels.values(), F.lit(alpha).alias("alpha")
    )
    painted = pred.join(palette, "cls", "left")
    return painted.fillna(0, subset=[*channels, "alpha"])
