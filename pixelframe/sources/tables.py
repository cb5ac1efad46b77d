"""Label tables on disk, cascading deletes and the score cache."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import UNLABELED


def write_labels(labels: DataFrame, path: str, role: str) -> None:
    """Replace the stored masks of exactly the scenes in `labels` for one role.

    Scenes share files by hash, so one huge scene is still written by many tasks: rows spread over
    (image_id, y) before the write, and only touched partitions are replaced.
    """
    rows = labels.select("image_id", "y", "x", "label").withColumn("role", F.lit(role))
    (
        rows.repartition("image_id", F.floor(F.col("y") / 256))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("role", "image_id")
        .parquet(path)
    )


def read_labels(spark: SparkSession, path: str, role: str) -> DataFrame:
    return (
        spark.read.parquet(path)
        .filter(F.col("role") == role)
        .select(F.col("image_id").cast("int"), "y", "x", "label")
    )


def labeled_samples(
    saved: DataFrame, session: DataFrame, split: DataFrame, scenes: DataFrame
) -> DataFrame:
    """Scenes with at least one labelled pixel, their label source, count and role.

    Unsaved session labels replace the saved ones of a scene as a whole.
    """
    touched = session.select("image_id").distinct()
    merged = saved.join(touched, "image_id", "left_anti").withColumn(
        "origin", F.lit("saved")
    ).unionByName(session.withColumn("origin", F.lit("session")))
    counts = (
        merged.groupBy("image_id", "origin")
        .agg(F.count_if(F.col("label") != UNLABELED).alias("labeled_px"))
        .filter(F.col("labeled_px") > 0)
    )
    return (
        counts.join(scenes.select("image_id", "name"), "image_id")
        .join(split.select("name", "role"), "name")
        .select("image_id", "name", "origin", "role", "labeled_px")
    )


def delete_images(names: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Remove the named scenes from every given table keyed by `name`."""
    gone = names.select("name").distinct()
    return {key: table.join(gone, "name", "left_anti") for key, table in tables.items()}


def scores_to_compute(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """Candidates whose score is not cached for their model and label version."""
    return candidates.join(cache, ["image_id", "model_version", "label_version"], "left_anti")


def cached_scores(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """The reusable part of the cache; the role is joined by the caller, never cached."""
    keys = ["image_id", "model_version", "label_version"]
    return cache.join(candidates.select(*keys), keys, "left_semi")
