"""Tile arithmetic: offsets, counts and the windows that cover a coordinate."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def tile_offsets(extent, tile, stride) -> Column:
    """Start offsets along one axis; the last window is moved back to the edge."""
    extent, tile, stride = _c(extent), _c(tile), _c(stride)
    last = (extent - tile).cast("int")
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride.cast("int"))
    covering = F.array_distinct(F.concat(steps, F.array(last)))
    return F.when(tile >= extent, F.array(F.lit(0))).otherwise(covering)


def tile_count(extent, tile, stride) -> Column:
    """Length of `tile_offsets` in closed form."""
    extent, tile, stride = _c(extent), _c(tile), _c(stride)
    last = extent - tile
    regular = F.floor(last / stride) + 1
    snapped = F.when(last % stride != 0, 1).otherwise(0)
    return F.when(tile >= extent, F.lit(1)).otherwise(regular + snapped).cast("int")


def covering_offsets(position, extent, tile, stride) -> Column:
    """The members of `tile_offsets` whose window contains `position`.

    Work per pixel depends on the overlap only, not on how many windows the axis has.
    """
    position, extent = _c(position), _c(extent)
    tile, stride = _c(tile), _c(stride)
    last = extent - tile
    first = F.greatest(F.lit(0), F.ceil((position - tile + 1) / stride)).cast("int")
    final = F.least(F.floor(position / stride), F.floor(last / stride)).cast("int")
    none = F.array().cast("array<int>")
    regular = F.when(
        first <= final,
        F.transform(F.sequence(first, final), lambda k: (k * stride).cast("int")),
    ).otherwise(none)
    snapped = F.when(
        (last % stride != 0) & (position >= last), F.array(last.cast("int"))
    ).otherwise(none)
    return F.when(tile >= extent, F.array(F.lit(0))).otherwise(F.concat(regular, snapped))
