"""Ordered computations over groups too large for one task.

A plain window sorts a whole group in a single task. These helpers sort inside coarse buckets of
the ordering key and carry one small row per bucket across, so a group that holds a third of the
table is spread over as many tasks as it has buckets.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


FOLDS = {
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, lambda before, here: F.least(before, here)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    folds: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running folds ("sum", "max", "min") per `keys` in (`bucket`, `order`) order.

    `bucket` must not decrease along `order`, and (`keys`, `bucket`) should hold a bounded number
    of rows: it is the unit one task sorts. With `inclusive=False` a row sees earlier rows only.
    """
    keys = list(keys)
    parts = df.withColumn(BUCKET, bucket)
    for name, (_, value) in folds.items():
        parts = parts.withColumn(f"_in_{name}", value)
    totals = parts.groupBy(*keys, BUCKET).agg(
        *[FOLDS[how][0](f"_in_{name}").alias(f"_all_{name}") for name, (how, _) in folds.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, BUCKET,
        *[
            FOLDS[how][0](f"_all_{name}").over(earlier).alias(f"_before_{name}")
            for name, (how, _) in folds.items()
        ],
    )
    within = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    joined = parts.join(offsets, [*keys, BUCKET])
    for name, (how, _) in folds.items():
        fold, combine = FOLDS[how]
        joined = joined.withColumn(
            name, combine(F.col(f"_before_{name}"), fold(f"_in_{name}").over(within))
        )
    return joined.drop(
        BUCKET, *[f"_in_{n}" for n in folds], *[f"_before_{n}" for n in folds]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums; see `running`."""
    return running(df, keys, bucket, order, {name: ("sum", v) for name, v in sums.items()})


def take_lowest(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    limit: Column,
) -> DataFrame:
    """The first `limit` rows per `keys` in (`bucket`, `order`) order.

    Buckets beyond the cut are dropped on their counts alone, before any sort; what is ranked, one
    bucket at a time, is at most `limit` rows and the bucket the cut falls into. `limit` may use the
    keys and `group_rows`, the number of rows of the key.
    """
    keys = list(keys)
    parts = df.withColumn(BUCKET, bucket)
    counts = parts.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_in"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        counts.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
        .withColumn("group_rows", F.sum("_in").over(group))
        .withColumn("_limit", limit)
        .filter(F.col("_before") < F.col("_limit"))
        .select(*keys, BUCKET, "_before", "_limit")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(*order))
    return (
        parts.join(spans, [*keys, BUCKET])
        .withColumn("_rank", rank)
        .filter(F.col("_rank") + F.col("_before") <= F.col("_limit"))
        .drop(BUCKET, "_limit", "_before", "_rank")
    )


def lag_in_chunks(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: str,
    columns: dict[str, str],
) -> DataFrame:
    """`lag(column)` per `keys` ordered by `order`, sorting one chunk at a time.

    `columns` maps a source column to the name of its lagged copy; the first row of a key gets
    null. `chunk` must not decrease along `order`.
    """
    keys = list(keys)
    parts = df.withColumn(BUCKET, chunk)
    carried = F.struct(*[F.col(c) for c in columns])
    within = Window.partitionBy(*keys, BUCKET).orderBy(order)
    inner = parts.withColumn("_own", F.lag(carried).over(within))
    tails = parts.groupBy(*keys, BUCKET).agg(F.max_by(carried, F.col(order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    tails = tails.select(*keys, BUCKET, F.lag("_tail").over(across).alias("_carry"))
    out = inner.join(tails, [*keys, BUCKET])
    for source, name in columns.items():
        out = out.withColumn(
            name,
            F.when(F.col("_own").isNotNull(), F.col(f"_own.{source}"))
            .otherwise(F.col(f"_carry.{source}")),
        )
    return out.drop(BUCKET, "_own", "_carry")


def marks_around(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: str, marked: Column, before: str, after: str
) -> DataFrame:
    """Add the greatest marked `order` at or below a row and the least at or above it, null where there is none.

    `bucket` as for `running`; its number stays as `BUCKET`, and rows are clustered by `keys` and it.
    """
    keys = list(keys)
    # A stated number: by size these rows would be merged into a few tasks, and callers make many rows of each.
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.withColumn(BUCKET, bucket).repartition(count, *keys, BUCKET)
    at = F.when(marked, F.col(order))
    totals = parts.groupBy(*keys, BUCKET).agg(F.max(at).alias("_last"), F.min(at).alias("_first"))
    by_bucket = Window.partitionBy(*keys).orderBy(BUCKET)
    totals = totals.select(
        *keys, BUCKET,
        F.max("_last").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.min("_first").over(by_bucket.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    within = Window.partitionBy(*keys, BUCKET).orderBy(order)
    up, down = (Window.unboundedPreceding, Window.currentRow), (Window.currentRow, Window.unboundedFollowing)
    return (
        parts.join(totals, [*keys, BUCKET])
        .withColumn(before, F.coalesce(F.max(at).over(within.rowsBetween(*up)), "_earlier"))
        .withColumn(after, F.coalesce(F.min(at).over(within.rowsBetween(*down)), "_later"))
        .drop("_earlier", "_later")
    )
