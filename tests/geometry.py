"""Synthetic scenes and single-machine twins to compare with."""

import numpy as np


def frame(spark, height, width, value, bands=1, image_id=0):
    """Normalised pixel rows from `value[y, x]` (or `value[b, y, x]`)."""
    cube = np.broadcast_to(np.asarray(value, dtype=float), (bands, height, width))
    rows = [
        (image_id, y, x, True, [float(v) for v in cube[:, y, x]])
        for y in range(height) for x in range(width)
    ]
    return spark.createDataFrame(
        rows, "image_id int, y int, x int, valid boolean, norm array<double>"
    )


def scene(spark, height, width, image_id=0):
    return spark.createDataFrame(
        [(image_id, "a.tif", height, width)], "image_id int, name string, height int, width int"
    )


def mask_rows(spark, mask, image_id=0):
    ys, xs = np.nonzero(mask)
    rows = [(image_id, int(y), int(x)) for y, x in zip(ys, xs)]
    return spark.createDataFrame(rows, "image_id int, y int, x int")


def samples(spark, points):
    return spark.createDataFrame(
        [(i, 0, y, x, p) for i, (y, x, p) in enumerate(points)],
        "sample_id int, image_id int, y int, x int, positive boolean",
    )


def flood(mask, seed):
    """Breadth-first distances from `seed` over 4-neighbours."""
    dist = {seed: 0}
    queue = [seed]
    for y, x in queue:
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            inside = 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1]
            if inside and mask[ny, nx] and (ny, nx) not in dist:
                dist[ny, nx] = dist[y, x] + 1
                queue.append((ny, nx))
    return dist


def component_labels(mask):
    seen, out = set(), {}
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) not in seen:
            part = flood(mask, (int(y), int(x)))
            seen.update(part)
            least = min(part)
            out.update({p: least for p in part})
    return out


def points(df):
    return {(r["y"], r["x"]) for r in df.collect()}
