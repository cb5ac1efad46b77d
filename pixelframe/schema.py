"""Column layouts and the fixed label vocabulary shared by every operator."""

from pyspark.sql import types as T

# The label vocabulary. A class index is its label value.
TARGET = 0
BACKGROUND = 1
EXCLUDED = 254
UNLABELED = 255

# Defaults of the data profile.
DEFAULT_NODATA = -9999.0
PATCH_SIZE = 96
PATCH_MULTIPLE = 16
SCORE_BATCH = 16
TRAIN_BATCH = 4
UNDO_LIMIT = 50
VALIDATION_RATIO = 0.2
ROLES = ("training", "validation")

# Band names of a ten-band stack.
TEN_BAND_NAMES = (
    "Red", "Green", "Blue", "NIR1", "RE1", "RE2", "RE3", "NIR2", "SWIR1", "SWIR2",
)

PIXELS = T.StructType([
    T.StructField("image_id", T.IntegerType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("bands", T.ArrayType(T.DoubleType()), False),
])

SCENES = T.StructType([
    T.StructField("image_id", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("height", T.IntegerType(), False),
    T.StructField("width", T.IntegerType(), False),
    T.StructField("band_count", T.IntegerType()),
    T.StructField("nodata", T.DoubleType()),
    *[T.StructField(f"t{c}", T.DoubleType()) for c in "abcdef"],
])

LABELS = T.StructType([
    T.StructField("image_id", T.IntegerType(), False),
    T.StructField("y", T.IntegerType(), False),
    T.StructField("x", T.IntegerType(), False),
    T.StructField("label", T.IntegerType(), False),
])

EDITS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.TimestampType()),
    T.StructField("image_id", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("value", T.IntegerType()),
    T.StructField("cx", T.DoubleType()),
    T.StructField("cy", T.DoubleType()),
    T.StructField("r", T.DoubleType()),
])

EPOCH_LOG = T.StructType([
    T.StructField("run_id", T.LongType(), False),
    T.StructField("epoch", T.IntegerType(), False),
    T.StructField("epochs", T.IntegerType(), False),
    T.StructField("iou", T.DoubleType()),
])

PIXEL_KEY = ["image_id", "y", "x"]
