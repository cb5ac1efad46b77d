"""Reading the given tables, and keys that survive nulls and repeated rows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_key(column: str = "text") -> Column:
    """Tells rows apart that share a doc_id; equal rows share it."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")), F.col(column).isNull())


def words(column: Column) -> Column:
    """Words of a text as an array: runs of anything but space, tab, LF, VT, FF and CR."""
    flat = F.translate(column, "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(flat, " ", -1), lambda w: w != "")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", parts: int = 16) -> DataFrame:
    """left join right on `keys`, a hot key of `left` in `parts` pieces.

    For a right side with one row per key, which is copied to each part. `spread` is any column of
    `left` that tells the rows of a key apart.
    """
    numbered = left.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return numbered.join(copied, [*keys, "_part"], how).drop("_part")
