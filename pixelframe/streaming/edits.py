"""Label edits as a stream: latest-wins state, save points and labelling rate."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.monitor import label_rate, save_points
from . import state


def stream_labels(
    edits: DataFrame,
    scenes: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    pred: DataFrame | None = None,
    buckets: int = state.BUCKETS,
) -> StreamingQuery:
    """Fold a stream of edits into the label state under `path` (`state.read_state`).

    With predictions `pred(image_id, y, x, valid, cls)` the confusion counts of every scene are kept
    up to date beside it (`state.read_live`).
    """
    shape = scenes.select("image_id", "height", "width")

    def fold(batch: DataFrame, batch_id: int) -> None:
        state.fold(batch, batch_id, shape, path, pred, buckets)

    return (
        edits.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _append(
    df: DataFrame, path: str, checkpoint: str, trigger: dict | None
) -> StreamingQuery:
    return (
        df.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_save_points(
    edits: DataFrame,
    path: str,
    checkpoint: str,
    quiet: str = "1 second",
    lateness: str = "10 seconds",
    trigger: dict | None = None,
) -> StreamingQuery:
    """`save_points` while edits arrive; a burst is emitted once the watermark has passed it."""
    return _append(
        save_points(edits.withWatermark("ts", lateness), quiet), path, checkpoint, trigger
    )


def stream_label_rate(
    edits: DataFrame,
    path: str,
    checkpoint: str,
    width: str,
    slide: str | None = None,
    lateness: str = "10 seconds",
    trigger: dict | None = None,
) -> StreamingQuery:
    """`label_rate` while edits arrive; closed windows only."""
    return _append(
        label_rate(edits.withWatermark("ts", lateness), width, slide), path, checkpoint, trigger
    )
