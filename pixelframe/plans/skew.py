"""Joins whose left side holds a key any number of times."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "_part"


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    parts: int = 16,
) -> DataFrame:
    """`left` join `right` on `keys`; a hot key of `left` falls into `parts` pieces by `spread`.

    `right` has one row per key and is copied to each piece.
    """
    numbered = left.withColumn(PART, F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    copied = right.withColumn(PART, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return numbered.join(copied, [*keys, PART], how).drop(PART)


def scene_join(
    rows: DataFrame, per_scene: DataFrame, spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """`rows` join a table of one row per scene; a scene's rows stay spread over tasks.

    Where the small side is broadcast nothing moves. Where it is not, a plain join would leave whole
    scenes in a task, and every grouping by scene and more would then go on inside that task.
    """
    return salted_join(rows, per_scene, ["image_id"], spread, how)
