"""Plans keep their shape: no pairing joins, pruned scans, and results independent of layout."""

import os
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from contract import q_select, registry
from contract.common import judged, normed
from contract.fixtures import pixels, view
from pixelframe.operators import evaluate, labels, regions, selection, tiling
from pixelframe.plans import graph
from pixelframe.session import cut

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "t3_tile_scenes", "t7_assign_patches", "t10_blend_windows", "l4_brush_stamp", "l6_polygon_fill",
    "l7_replay", "l8_edit_diff", "e1_confusion", "e4_image_scores", "i9_sample_bilinear",
    "w5_match_set", "w8_nearest_budget", "w13_selection_edges", "a8_composed_patches",
    "w14_vector_search",
])
def test_no_pairing_joins(spark, small, name):
    plan = plan_of(registry.QUERIES[name](spark, small))
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_patch_assignment_needs_no_shuffle(spark, small):
    shape = spark.createDataFrame([(0, 30, 50)], "image_id int, height int, width int")
    assert "Exchange hashpartitioning" not in plan_of(
        tiling.assign_patches(pixels(spark, small), F.broadcast(shape), 16, 8))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [
    "p3_normalize", "p8_overview", "t3_tile_scenes", "t8_patch_assembly", "t9_patch_label_stats", "t10_blend_windows",
    "i6_predict_scene", "l4_brush_stamp", "l6_polygon_fill", "l7_replay", "l8_edit_diff",
])
def test_no_scene_in_one_task(spark, small, no_broadcast, name):
    """Where scenes are too many to broadcast, rows of a scene stay dealt by more than the scene."""
    plan = plan_of(registry.QUERIES[name](spark, small))
    joins = re.findall(r"SortMergeJoin(?:\(skew=true\))? \[([^\]]*)\]", plan)
    assert joins and not [keys for keys in joins if re.fullmatch(r"image_id#\d+L?", keys)]
    assert "_part#" in plan


@pytest.mark.parametrize("name", ["p7_world_xy", "l6_polygon_fill", "w8_nearest_budget"])
def test_building_a_query_persists_nothing(spark, small, name):
    registry.QUERIES[name](spark, small)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_confusion_scans_only_what_it_needs(spark, small):
    plan = plan_of(evaluate.confusion(view(spark, small, "eval_docs")))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert not any("text" in s or "lang" in s for s in schemas)


def test_blend_shuffles_once(spark, small):
    rows = tiling.assign_patches(
        normed(spark, small), view(spark, small, "scenes"), 16, 8
    ).withColumn("logits", F.slice("norm", 1, 2))
    before, after = (plan_of(d).count("Exchange hashpartitioning") for d in (rows, tiling.blend(rows)))
    assert after == before + 1


@pytest.mark.parametrize("name", [
    "p2_band_stats_large_scenes", "t10_blend_windows", "e16_lovasz", "l8_edit_diff",
    "d2_base_split", "a1_epoch_order", "w9_select_connected",
])
def test_layout_does_not_change_results(spark, small, partitions, name):
    def rows():
        return sorted(map(repr, registry.QUERIES[name](spark, small).collect()))

    assert partitions(1, rows) == partitions(7, rows)


def test_library_never_pulls_data_to_the_driver():
    for folder, _, files in os.walk(os.path.join(ROOT, "pixelframe")):
        # The optional subpackage has a rule of its own.
        for name in [] if folder.split(os.sep)[-1] == "llm" else files:
            if name.endswith(".py"):
                text = open(os.path.join(folder, name)).read()
                assert not re.search(r"\.collect\(\)|toPandas|localCheckpoint|crossJoin|\.rdd\b", text), name


def test_hot_scene_is_spread_over_buckets(spark, small):
    """Ordered helpers never window by scene alone: the bucket is part of the partitioning."""
    plan = plan_of(labels.edit_diff(view(spark, small, "edits"), view(spark, small, "scenes")))
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    assert any("_bucket" in w for w in windows)


def test_rows_under_test_are_whole(spark, small):
    assert judged(spark, small).count() == 1500


def test_entry_works_from_another_folder(tmp_path):
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "q = e.queries()['i1_score_patches'](s, '/root/testdata/sf0.001')\n"
        "print('rows', q.count(), e.entry(s).count())\n"
    )
    done = subprocess.run(
        [os.sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 4608 1" in done.stdout, done.stderr[-2000:]


def test_components_broadcast_nothing_that_grows_with_the_pixels(spark):
    """Files of the checkpoint folder are far smaller than their rows: joins on them never broadcast."""
    mask = spark.range(40).select(F.lit(1).alias("image_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    labelled = regions.components(mask, block=8)
    plan = plan_of(labelled)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [r.component for r in labelled.select("component").distinct().collect()] == [0]


def test_a_single_grid_is_spread_over_tasks(spark, no_broadcast):
    """The vectors of one scene meet its mean and its samples in several pieces."""
    grid = spark.range(12).select(
        F.lit(0).alias("image_id"), F.lit(0).alias("gy"), F.col("id").cast("int").alias("gx"),
        F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vec"))
    shape = spark.createDataFrame([(0, 1, 12, 10, 120)], "image_id int, gh int, gw int, height int, width int")
    clicks = spark.createDataFrame([(1, 0, 5, 60, True)], "sample_id int, image_id int, y int, x int, positive boolean")
    unit = selection.center_unit(grid)
    whole = r"SortMergeJoin(?:\(skew=true\))? \[image_id#\d+L?\]"
    assert not re.findall(whole, plan_of(unit)) and "_part#" in plan_of(unit)
    # Clicks meet the shape of their scene; nothing else is joined by scene alone.
    assert len(re.findall(whole, plan_of(selection.cosine_field(unit, clicks, shape)))) == 1
    length = [sum(v * v for v in row.unit) for row in unit.collect()]
    assert all(abs(v - 1) < 1e-12 for v in length)


def test_matched_pixels_are_read_once_and_not_joined_with_themselves(spark, small):
    """Samples' distances and their negatives' meet in one row: no join or grouping by pixel, references kept."""
    plan = plan_of(q_select._matched(spark, small, q_select.WIDE))
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"Scan parquet .*o_totalprice", final)) == 1
    assert not re.findall(r"Join[^\n]*\[image_id#\d+L?, y#\d+", final)


def test_contraction_joins_broadcast_nothing(spark, monkeypatch):
    """Every join of a contraction of several rounds, inside the loop too, leaves both sides unbroadcast."""
    plans = []

    def seen(df):
        plans.append(plan_of(df))
        return cut(df)

    monkeypatch.setattr(graph, "cut", seen)
    path = [(a, b) for i in range(40) for a, b in ((i * 7 % 41, (i + 1) * 7 % 41), ((i + 1) * 7 % 41, i * 7 % 41))]
    links = spark.createDataFrame([(1, a, b) for a, b in path], "image_id int, a long, b long")
    roots = graph.contract(links, ["image_id"])
    joined = [p for p in [*plans, plan_of(roots)] if "Join" in p]
    assert len(joined) > 3 and not [p for p in joined if "Broadcast" in p or "ShuffledHash" in p]
    assert sorted(r.node for r in roots.collect() if r.root == 0) == list(range(1, 41))


def test_region_edges_make_two_rows_a_pixel(spark):
    """A shared edge is counted once, at the lower or right pixel: what is grouped is 3 rows a pixel, not 5."""
    cells = [(1, y, x, 0) for y in range(5) for x in range(4) if (y, x) != (2, 2)]
    labelled = spark.createDataFrame(cells, "image_id int, y int, x int, component long")
    found = regions.regions(labelled, min_area=1)
    assert " + -1)" not in plan_of(found)
    assert [(r.area, r.exposed) for r in found.collect()] == [(19, 22)]
