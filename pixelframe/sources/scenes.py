"""Scene catalog, raster ingest, scene checks and the mask fit join."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULT_NODATA, PATCH_MULTIPLE, PATCH_SIZE

# Fixed value: suffixes a scene file may have, in any case.
SCENE_SUFFIX = r"\.tiff?$"

CATALOG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("length", T.LongType()),
])

DECODED = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("band_count", T.IntegerType()),
    T.StructField("nodata", T.DoubleType()),
    T.StructField("crs", T.StringType()),
    T.StructField("affine", T.ArrayType(T.DoubleType())),
    T.StructField("y", T.IntegerType()),
    T.StructField("bands", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def _binary_files(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return None


def list_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scene files of a folder by name; a missing folder gives no rows. Contents are not read."""
    files = _binary_files(spark, path)
    if files is None:
        return spark.createDataFrame([], CATALOG)
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(name.alias("name"), "path", "length")
        .filter(F.lower("name").rlike(SCENE_SUFFIX))
        .orderBy("name")
    )


def ingest(
    spark: SparkSession, path: str, decoder: Callable[[bytes, str], dict]
) -> DataFrame:
    """Decode every scene file of a folder into pixel rows.

    `decoder(content, path)` returns `{"bands": array[c, h, w], "nodata": float | None,
    "crs": str | None, "affine": six numbers | None}`. A file travels to one task and leaves it
    one raster row at a time; pixels are exploded on the JVM side.
    """
    files = _binary_files(spark, path)
    if files is None:
        return spark.createDataFrame([], _ingested_schema())
    scenes = files.filter(F.lower("path").rlike(SCENE_SUFFIX)).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file_path, content in zip(batch["path"], batch["content"]):
                raster = decoder(content, file_path)
                bands = raster["bands"]
                count, height, width = bands.shape
                nodata = raster.get("nodata")
                affine = raster.get("affine")
                head = {
                    "name": file_path.rsplit("/", 1)[-1],
                    "height": height,
                    "width": width,
                    "band_count": count,
                    "nodata": DEFAULT_NODATA if nodata is None else float(nodata),
                    "crs": raster.get("crs"),
                    "affine": None if affine is None else [float(v) for v in affine],
                }
                for y in range(height):
                    row = bands[:, y, :].T.astype("float64")
                    yield pd.DataFrame([{**head, "y": y, "bands": row.tolist()}])

    rows = scenes.mapInPandas(decode, DECODED)
    return rows.select(
        "name", "height", "width", "band_count", "nodata", "crs", "affine", "y",
        F.posexplode("bands").alias("x", "bands"),
    )


def _ingested_schema() -> T.StructType:
    keep = [f for f in DECODED.fields if f.name != "bands"]
    return T.StructType([
        *keep,
        T.StructField("x", T.IntegerType()),
        T.StructField("bands", T.ArrayType(T.DoubleType())),
    ])


def probe_bands(scenes: DataFrame) -> DataFrame:
    """Band count of the first readable scene by name, null when none is readable."""
    return scenes.agg(
        F.min_by("band_count", F.when(F.col("band_count").isNotNull(), F.col("name"))).alias(
            "band_count"
        )
    )


def validate_scenes(scenes: DataFrame, band_count: int, patch: int = PATCH_SIZE) -> DataFrame:
    """Add `errors`: the reasons a scene does not fit the project's data profile."""
    checks: list[tuple[Column, Column]] = [
        (F.col("band_count").isNull(), F.lit("unreadable")),
        (
            F.col("band_count") != band_count,
            F.concat(F.lit(f"expected {band_count} bands, got "), F.col("band_count")),
        ),
        (
            F.least("height", "width") < patch,
            F.concat(
                F.col("width"), F.lit("x"), F.col("height"),
                F.lit(f" is smaller than the {patch}px patch"),
            ),
        ),
        (F.lit(patch % PATCH_MULTIPLE != 0), F.lit(f"patch must be a multiple of {PATCH_MULTIPLE}")),
    ]
    found = F.array(*[F.when(bad, text) for bad, text in checks])
    return scenes.withColumn("errors", F.array_compact(found))


def fit_masks(
    masks_meta: DataFrame, scenes: DataFrame, band_count: int
) -> tuple[DataFrame, DataFrame]:
    """Split saved masks into (usable, stale) by the shape and band count of their scene."""
    shape = scenes.filter(F.col("band_count") == band_count).select("name", "height", "width")
    usable = masks_meta.join(shape, ["name", "height", "width"], "left_semi")
    stale = masks_meta.join(shape, ["name", "height", "width"], "left_anti")
    return usable, stale
