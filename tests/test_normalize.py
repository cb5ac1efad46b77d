import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contract.fixtures import pixels, view
from pixelframe.functions.windows import covering_offsets, tile_offsets
from pixelframe.operators import normalize, scoring, split
from pixelframe.session import cut


def px_frame(spark, cube, nodata=-9999.0):
    c, h, w = cube.shape
    rows = [
        (0, y, x, [float(v) for v in cube[:, y, x]]) for y in range(h) for x in range(w)
    ]
    return normalize.with_valid(
        spark.createDataFrame(rows, "image_id int, y int, x int, bands array<double>"), nodata
    )


def stats_of(df):
    return {r["band"]: (r["lo"], r["hi"]) for r in df.collect()}


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_percentiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    cube = np.stack([
        rng.normal(size=(40, 30)) * 100,
        np.where(rng.random((40, 30)) < 0.4, 5.0, rng.normal(size=(40, 30))),  # one hot value
        rng.integers(0, 7, (40, 30)).astype(float),
    ])
    cube[:, 3, 4] = -9999
    cube[0, 5, 5] = -9999
    px = px_frame(spark, cube)
    valid = (cube != -9999).all(axis=0)
    found = stats_of(normalize.band_stats(px, accuracy=accuracy))
    for b in range(3):
        want = np.percentile(cube[b][valid], (2, 98))
        assert np.allclose(found[b], want, rtol=0, atol=1e-9)


def test_percentile_bracket_is_widened_until_it_holds(spark):
    rng = np.random.default_rng(5)
    cube = rng.normal(size=(1, 60, 50))
    found = stats_of(normalize._close(normalize.bracket_stats(px_frame(spark, cube), .02, .98, 20)))
    assert np.allclose(found[0], np.percentile(cube[0], (2, 98)), rtol=0, atol=1e-9)


def test_approximate_stats_are_near(spark):
    rng = np.random.default_rng(7)
    cube = rng.random((1, 50, 50))
    lo, hi = stats_of(normalize.band_stats(px_frame(spark, cube), approx=True))[0]
    assert abs(lo - 0.02) < 0.02 and abs(hi - 0.98) < 0.02


def test_sketches_merge_without_pixels(spark):
    rng = np.random.default_rng(8)
    cubes = [rng.normal(i, 1 + i, size=(2, 60, 50)) for i in range(3)]
    cubes.append(np.full((2, 60, 50), -9999.0))
    px = px_frame(spark, cubes[0]).withColumn("image_id", F.lit(0))
    for i, cube in enumerate(cubes[1:], 1):
        px = px.unionByName(px_frame(spark, cube).withColumn("image_id", F.lit(i)))
    sketches = cut(normalize.scene_sketches(px, 256))
    sets = spark.createDataFrame([(0, 7), (2, 7), (2, 7), (1, 8), (3, 8), (3, 9)], "image_id int, set_id int")
    merged = normalize.merged_stats(sketches, sets)
    rows = {(r["set_id"], r["band"]): r for r in merged.collect()}
    for set_id, members in ((7, (0, 2)), (8, (1,))):
        for band in range(2):
            values = np.sort(np.concatenate([cubes[i][band].ravel() for i in members]))
            row = rows[set_id, band]
            assert row["n"] == len(values)
            for name, share in (("lo", 0.02), ("hi", 0.98)):
                assert abs(np.searchsorted(values, row[name]) / len(values) - share) <= 3 * normalize.rank_error(256)
    assert (rows[9, 0]["n"], rows[9, 0]["lo"], rows[9, 0]["hi"]) == (0, 0.0, 1.0)


def test_empty_and_flat_scenes(spark):
    cube = np.full((2, 4, 4), -9999.0)
    px = px_frame(spark, cube)
    assert stats_of(normalize.band_stats(px)) == {0: (0.0, 1.0), 1: (0.0, 1.0)}
    flat = px_frame(spark, np.full((1, 4, 4), 7.0))
    assert stats_of(normalize.band_stats(flat)) == {0: (7.0, 8.0)}
    norm = normalize.normalize(px, normalize.band_stats(px)).collect()
    assert all(r["norm"] == [0.0, 0.0] for r in norm)


def test_nan_nodata_matches_nan_pixels(spark):
    cube = np.ones((1, 4, 4))
    cube[0, 0, 0] = np.nan
    px = px_frame(spark, cube, float("nan"))
    assert px.filter("not valid").count() == 1
    assert px_frame(spark, cube).filter("not valid").count() == 0


def test_band_mapping_checks(spark, small):
    px = pixels(spark, small)
    with pytest.raises(ValueError, match="3 channels"):
        normalize.select_bands(px, 3, 4, [1, 2])
    with pytest.raises(ValueError, match="of 4 do not give"):
        normalize.select_bands(px, 2, 4, [0, 2])
    with pytest.raises(ValueError, match="5 channels"):
        normalize.select_bands(px, 5, 4)
    assert normalize.select_bands(px, 2, 4).first()["nodata"] == -9999.0
    assert normalize.select_bands(px, 2, 4, nodata=1, source_nodata=2).first()["nodata"] == 1.0


def test_band_names():
    assert normalize.band_names(3) == ["Band 1", "Band 2", "Band 3"]
    assert normalize.band_names(10)[3] == "NIR1"
    assert normalize.display_bands(2) == [0, 1, 1]


@pytest.mark.parametrize("total,tile,stride,want", [
    (50, 16, 8, [0, 8, 16, 24, 32, 34]), (48, 16, 8, [0, 8, 16, 24, 32]), (16, 16, 8, [0]),
    (10, 16, 8, [0]), (101, 32, 24, [0, 24, 48, 69]),
])
def test_window_arithmetic(spark, total, tile, stride, want):
    rows = spark.range(total).select(
        tile_offsets(F.lit(total), F.lit(tile), F.lit(stride)).alias("all"),
        covering_offsets(F.col("id").cast("int"), F.lit(total), F.lit(tile), F.lit(stride)).alias("own"),
        "id",
    ).collect()
    for row in rows:
        assert row["all"] == want
        assert sorted(row["own"]) == [o for o in want if o <= row["id"] < o + max(tile, total if tile >= total else tile)]


def test_split_rank_is_the_digest_order(spark, small):
    names = view(spark, small, "scenes").select("name").union(
        spark.range(50).select(F.concat(F.lit("n"), "id").alias("name"))
    )
    ranks = {r["name"]: r["rank"] for r in names.withColumn(
        "rank", split.split_rank("name")).collect()}
    for name, rank in ranks.items():
        assert rank == hashlib.blake2b(name.encode(), digest_size=8).hexdigest()
    low = {r["name"] for r in split.base_validation(names, 0.3).collect()}
    assert low == set(sorted(ranks, key=lambda n: (ranks[n], n))[:int(0.3 * len(ranks))])


def test_split_truncates_the_float_product(spark):
    names = spark.range(100).select(F.concat(F.lit("n"), "id").alias("name"))
    assert split.base_validation(names, 0.29).count() == int(0.29 * 100) == 28
    assert split.base_validation(names, 0.0).count() == 0


@pytest.mark.parametrize("grid,size", [((5, 7), (23, 31)), ((6, 4), (3, 2)), ((1, 1), (4, 5)), ((2, 3), (2, 3)), ((3, 9), (50, 4))])
def test_resize_equals_numpy(spark, grid, size):
    """Enlarged, shrunk, one cell, same size; a cell without a row and one without a value read as 0."""
    values = np.random.default_rng(5).normal(size=grid)
    values[-1, -1] = 0
    holes = {(grid[0] - 1, grid[1] - 1)} if grid != (1, 1) else set()
    cells = [(9, y, x, float(values[y, x])) for y in range(grid[0]) for x in range(grid[1]) if (y, x) not in holes]
    if grid[1] > 1:
        values[0, 1] = 0
        cells = [(*c[:3], None) if c[1:3] == (0, 1) else c for c in cells]
    field = spark.createDataFrame(cells + [(8, 0, 0, 1.0)], "image_id int, gy int, gx int, v double")
    shape = spark.createDataFrame([(9, *grid, *size)], "image_id int, gh int, gw int, height int, width int")
    got = np.full(size, np.nan)
    rows = scoring.resize_field(field, shape).collect()
    for row in rows:
        assert row["image_id"] == 9
        got[row["y"], row["x"]] = row["d"]
    ys, xs = (np.maximum((np.arange(n) + 0.5) / n * g - 0.5, 0) for n, g in zip(size, grid))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, grid[0] - 1), np.minimum(x0 + 1, grid[1] - 1)
    ty, tx = (ys - y0)[:, None], (xs - x0)[None]
    want = ((1 - ty) * (1 - tx) * values[np.ix_(y0, x0)] + (1 - ty) * tx * values[np.ix_(y0, x1)]
            + ty * (1 - tx) * values[np.ix_(y1, x0)] + ty * tx * values[np.ix_(y1, x1)])
    assert len(rows) == size[0] * size[1]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_overview_reads_its_pixels_once(spark):
    """Range and stretch come from one set of sums: sums made twice may differ in their last bits."""
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    rows = [(0, y, x, [float(y * 7 + x)] * 3) for y in range(6) for x in range(8)]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, bands array<double>")
    shape = spark.createDataFrame([(0, 6, 8)], "image_id int, height int, width int")
    small = normalize.downsample(px.mapInPandas(counted, px.schema), shape, 3, size=4).collect()
    assert len(small) == 12 and reads.value == len(rows)


def test_overview_sums_in_a_fixed_order(spark):
    """However the pixels are stored or dealt, a cell's mean is the same double: its pixels add up in one order."""
    rng = np.random.default_rng(11)
    rows = [(0, y, x, [float(v) for v in rng.random(3) * 10.0 ** rng.integers(-6, 7, 3)])
            for y in range(24) for x in range(32)]
    shape = spark.createDataFrame([(0, 24, 32)], "image_id int, height int, width int")

    def means(rows, parts):
        px = spark.createDataFrame(rows, "image_id int, y int, x int, bands array<double>").repartition(parts)
        small = normalize.downsample(px, shape, 3, size=4)
        return {(r["y"], r["x"]): r["bands"] for r in small.collect()}

    first = means(rows, 1)
    assert len(first) == 12 and means(rows[::-1], 1) == first
    assert all(means([rows[i] for i in rng.permutation(len(rows))], parts) == first for parts in (1, 5))
