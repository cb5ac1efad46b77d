import numpy as np
import pytest
from pyspark.sql import functions as F

from contract.fixtures import view
from pixelframe.operators import overlay
from pixelframe.sources import scenes, tables


@pytest.fixture
def folder(tmp_path):
    for name in ("b.TIFF", "a.tif", "notes.txt", "c.tif.bak"):
        np.save(tmp_path / "x.npy", np.arange(24.0).reshape(2, 3, 4))
        (tmp_path / name).write_bytes((tmp_path / "x.npy").read_bytes())
    (tmp_path / "x.npy").unlink()
    return str(tmp_path)


def test_catalog_lists_scenes_by_name(spark, folder):
    assert [r["name"] for r in scenes.list_scenes(spark, folder).collect()] == ["a.tif", "b.TIFF"]
    assert scenes.list_scenes(spark, folder + "/missing").count() == 0


def test_ingest_gives_pixel_rows(spark, folder):
    def toy_decoder(content, path):
        import io

        import numpy

        bands = numpy.load(io.BytesIO(content))
        return {"bands": bands, "nodata": None, "crs": "EPSG:1", "affine": [1, 0, 0, 0, -1, 0]}

    px = scenes.ingest(spark, folder, toy_decoder)
    assert px.count() == 2 * 12
    row = px.filter("name = 'a.tif' and y = 2 and x = 3").first()
    assert row["bands"] == [11.0, 23.0] and row["nodata"] == -9999.0 and row["band_count"] == 2
    assert row["affine"] == [1, 0, 0, 0, -1, 0]
    assert scenes.ingest(spark, folder + "/missing", toy_decoder).count() == 0


def test_probe_skips_unreadable(spark):
    df = spark.createDataFrame([("a", None), ("b", 4), ("c", 3)], "name string, band_count int")
    assert scenes.probe_bands(df).first()["band_count"] == 4
    assert scenes.probe_bands(df.filter("name = 'a'")).first()["band_count"] is None


def test_patch_multiple_is_checked(spark, small):
    checked = scenes.validate_scenes(view(spark, small, "scenes"), 4, 20).first()
    assert any("multiple of 16" in e for e in checked["errors"])


def test_label_sink_replaces_only_touched_scenes(spark, tmp_path):
    rows = spark.createDataFrame(
        [(i, 0, x, 0) for i in (1, 2) for x in range(3)], "image_id int, y int, x int, label int")
    path = str(tmp_path / "labels")
    tables.write_labels(rows, path, "user")
    tables.write_labels(rows.filter("image_id = 2 and x = 0").withColumn("label", F.lit(1)), path, "user")
    got = sorted((r["image_id"], r["x"], r["label"]) for r in tables.read_labels(spark, path, "user").collect())
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 1)]


def test_overlay_leaves_unknown_ids_clear(spark):
    pred = spark.createDataFrame([(0,), (7,), (255,)], "cls int")
    classes = spark.createDataFrame([(0, "t", "#ff5028"), (255, "u", "#ffffff")], "id int, name string, color string")
    got = {r["cls"]: (r["red"], r["green"], r["blue"], r["alpha"])
           for r in overlay.colorize(pred, classes).collect()}
    assert got == {0: (255, 80, 40, 160), 7: (0, 0, 0, 0), 255: (0, 0, 0, 0)}
