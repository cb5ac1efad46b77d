"""Label state that micro-batches update in place of appending to a history.

Pixels live in a fixed number of buckets, blocks of a scene together. A micro-batch rewrites only the
buckets it touches, as a new version, and then writes a manifest that names the version of every
bucket. A manifest is one row in a folder of its own and counts once it is complete, so readers see
whole versions only and a batch that is run again starts from the version before it. Folders that
neither of the last two manifests names are removed: reading and storing cost the state, not what led
to it.

With predictions beside them, confusion counts follow the labels under retraction: a pixel whose label
changes takes its old contribution out and puts the new one in.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import COUNTS, confusion, metric_columns
from ..operators.labels import stamp_sized
from ..plans.sizing import is_empty
from ..plans.skew import scene_join
from ..schema import PIXEL_KEY, UNLABELED
from ..session import cut

BUCKETS = 64
BLOCK = 64  # pixels on a side that share a bucket
ROWS = "image_id int, y int, x int, seq bigint, label int, prev int"
CLEARS = "image_id int, seq bigint"
LIVE = "image_id int, tp bigint, fp bigint, fn bigint, tn bigint"
MANIFEST = "buckets map<int,bigint>, clears bigint, live bigint"


@dataclass
class Manifest:
    """The version of each bucket that holds rows, of the clears, and of the live counts."""

    buckets: dict[int, int] = field(default_factory=dict)
    clears: int | None = None
    live: int | None = None


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches, none if it is missing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of complete manifests, in order."""
    names = _folders(spark, f"{path}/manifest")
    return sorted(
        int(n.split("=")[1]) for n in names if "_SUCCESS" in _folders(spark, f"{path}/manifest/{n}")
    )


def manifest_of(spark: SparkSession, path: str, before: int | None = None) -> Manifest:
    """The last complete manifest, or the last one below version `before`."""
    known = [v for v in complete_versions(spark, path) if before is None or v < before]
    if not known:
        return Manifest()
    row = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={known[-1]}").first()
    return Manifest(dict(row["buckets"]), row["clears"], row["live"])


def _rows(spark: SparkSession, path: str, at: Manifest, only: list[int] | None = None) -> DataFrame:
    wanted = [b for b in at.buckets if only is None or b in only]
    if not wanted:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(
        *[f"{path}/data/version={at.buckets[b]}/bucket={b}" for b in wanted]
    )


def _small(spark: SparkSession, path: str, name: str, version: int | None, schema: str) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}/version={version}")


def bucket_of(buckets: int) -> Column:
    block = [F.floor(F.col(c) / BLOCK) for c in ("y", "x")]
    return F.pmod(F.xxhash64("image_id", *block), F.lit(buckets)).cast("int")


def _labels(spark: SparkSession, path: str, at: Manifest) -> DataFrame:
    clears = _small(spark, path, "clears", at.clears, CLEARS).withColumnRenamed("seq", "_wiped")
    return (
        scene_join(_rows(spark, path, at), clears, ["y", "x"], "left")
        .filter(F.col("_wiped").isNull() | (F.col("seq") > F.col("_wiped")))
        .filter(F.col("label") != UNLABELED)
        .select(*PIXEL_KEY, "label", "seq")
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current labels: labelled pixels with the edit that set them."""
    return _labels(spark, path, manifest_of(spark, path))


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Confusion counts and live IoU of every scene that has counted pixels."""
    counts = _small(spark, path, "live", manifest_of(spark, path).live, LIVE)
    live = F.when(F.col("tp") + F.col("fn") > 0, metric_columns()["iou"])
    return counts.filter("tp + fp + fn + tn > 0").withColumn("iou", live)


def _commit(spark: SparkSession, path: str, version: int, at: Manifest) -> None:
    rows = spark.createDataFrame([(at.buckets, at.clears, at.live)], MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    kept = [v for v in complete_versions(spark, path)][-2:]
    named = [manifest_of(spark, path, v + 1) for v in kept]
    used = {("data", v) for m in named for v in m.buckets.values()}
    used |= {("clears", m.clears) for m in named} | {("live", m.live) for m in named}
    used |= {("manifest", v) for v in kept}
    for name in ("data", "clears", "live", "manifest"):
        for folder in _folders(spark, f"{path}/{name}"):
            number = int(folder.split("=")[1])
            # Newer ones may be of a batch that did not get as far as its manifest.
            if (name, number) not in used and number <= version:
                _remove(spark, f"{path}/{name}/{folder}")


def _write_buckets(rows: DataFrame, path: str, version: int) -> set[int]:
    """Write rows with a `bucket` as `version`; the buckets that hold any."""
    folder = f"{path}/data/version={version}"
    spread = F.pmod(F.xxhash64("y", "x"), F.lit(4))
    rows.repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    spark = rows.sparkSession
    found = spark.read.schema(f"{ROWS}, bucket int").parquet(folder)
    return set(found.agg(F.collect_set("bucket").alias("b")).first()["b"])


def fold(
    batch: DataFrame, version: int, shape: DataFrame, path: str, pred: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> None:
    """Apply a batch of edits (`stamp`, `clear`) as `version`, on top of the version before it.

    The greatest `seq` of a pixel wins, so late, repeated and reordered edits change nothing.
    """
    spark = batch.sparkSession
    base = manifest_of(spark, path, version)
    stamps = scene_join(batch.filter("kind = 'stamp'"), shape, ["cx", "cy"])
    fresh = cut(
        stamp_sized(stamps).groupBy(*PIXEL_KEY)
        .agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("label"))
        .withColumn("bucket", bucket_of(buckets))
    )
    wipes = cut(batch.filter("kind = 'clear'").groupBy("image_id").agg(F.max("seq").alias("seq")))
    known = _small(spark, path, "clears", base.clears, CLEARS)
    after = Manifest(dict(base.buckets), base.clears, base.live)
    cleared = not is_empty(wipes)
    if cleared:
        merged = known.unionByName(wipes).groupBy("image_id").agg(F.max("seq").alias("seq"))
        merged.coalesce(1).write.mode("overwrite").parquet(f"{path}/clears/version={version}")
        after.clears = version
        known = _small(spark, path, "clears", version, CLEARS)

    touched = fresh.agg(F.collect_set("bucket").alias("b")).first()["b"]
    stored = _rows(spark, path, base, touched).select(
        *PIXEL_KEY, "seq", "label", bucket_of(buckets).alias("bucket"),
        F.col("seq").alias("_seq"), F.col("label").alias("_label"),
    )
    both = stored.unionByName(fresh, allowMissingColumns=True).groupBy(*PIXEL_KEY, "bucket").agg(
        F.max("seq").alias("seq"), F.max_by("label", "seq").alias("label"),
        F.max("_seq").alias("_seq"), F.max("_label").alias("_label"),
    )
    wiped = known.withColumnRenamed("seq", "_wiped")
    stands = lambda seq: F.col(seq).isNotNull() & (F.col("_wiped").isNull() | (F.col(seq) > F.col("_wiped")))
    rows = scene_join(both, wiped, ["y", "x"], "left").filter(stands("seq")).select(
        *PIXEL_KEY, "seq", "label", F.when(stands("_seq"), F.col("_label")).otherwise(UNLABELED).alias("prev"),
        "bucket",
    )
    if touched:
        present = _write_buckets(rows, path, version)
        for b in touched:
            after.buckets.pop(b, None)
        after.buckets |= {b: version for b in present}
    if pred is not None:
        changed = _rows(spark, path, Manifest({b: v for b, v in after.buckets.items() if v == version}))
        _follow(spark, path, base, after, changed, wipes, pred).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/live/version={version}"
        )
        after.live = version
    _commit(spark, path, version, after)


def _follow(
    spark: SparkSession, path: str, base: Manifest, after: Manifest, changed: DataFrame,
    wipes: DataFrame, pred: DataFrame,
) -> DataFrame:
    """Live counts after a batch: those before it, less old and plus new contributions.

    A scene cleared in this batch is counted anew from its few remaining labels.
    """
    guess = pred.select(*PIXEL_KEY, "valid", "cls")
    moved = changed.filter("label <> prev").join(wipes, "image_id", "left_anti")
    parts = [_small(spark, path, "live", base.live, LIVE).join(wipes, "image_id", "left_anti")]
    for column, sign in (("label", 1), ("prev", -1)):
        labels = moved.select(*PIXEL_KEY, F.col(column).alias("label"))
        counts = confusion(labels.join(guess, PIXEL_KEY))
        parts.append(counts.select("image_id", *[(F.col(c) * sign).alias(c) for c in COUNTS]))
    anew = _labels(spark, path, after).join(wipes, "image_id", "left_semi")
    parts.append(confusion(anew.join(guess, PIXEL_KEY)))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


def copy_state(spark: SparkSession, path: str, into: str, buckets: int = BUCKETS) -> None:
    """The current labels as version 0 of a new state, with any number of buckets; live counts are kept."""
    at = manifest_of(spark, path)
    rows = _labels(spark, path, at).withColumn("prev", F.col("label")).withColumn("bucket", bucket_of(buckets))
    new = Manifest({b: 0 for b in _write_buckets(rows, into, 0)})
    # A write that is older than its scene's clear may still arrive.
    for name, version, schema in (("clears", at.clears, CLEARS), ("live", at.live, LIVE)):
        if version is not None:
            _small(spark, path, name, version, schema).coalesce(1).write.parquet(f"{into}/{name}/version=0")
            setattr(new, name, 0)
    _commit(spark, into, 0, new)
