"""Windows, scoring and what is read off the model output."""

from pyspark.sql import functions as F

from pixelframe.functions.windows import tile_count, tile_offsets
from pixelframe.operators import labels, scoring, tiling

from .common import PATCH, STRIDE, normed, predicted, r, truth, valid_px
from .fixtures import fixture_logits, fixture_model, neighbour_model, pixels, table, view
from .registry import cte, query

cte("axis_y", "select unnest([0, 8, 14]) as ty")
cte("axis_x", "select unnest([0, 8, 16, 24, 32, 34]) as tx")
cte("grid_sql", "select image_id, cast(ty as int) as ty, cast(tx as int) as tx from scenes, axis_y, axis_x")
cte("assigned_sql", """
select p.image_id, g.ty, g.tx, p.y, p.x, p.y - g.ty as dy, p.x - g.tx as dx
from px p join grid_sql g on g.image_id = p.image_id
 and p.y >= g.ty and p.y < g.ty + 16 and p.x >= g.tx and p.x < g.tx + 16""")


def _sizes(spark, sf):
    """Axis lengths read off the part table, with tile and stride varying by row."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        (F.col("p_size") + 5).cast("int").alias("total"),
        (F.col("p_partkey") % 13 + 4).cast("int").alias("tile"),
        (F.col("p_partkey") % 5 + 1).cast("int").alias("stride"),
    )


SIZES = """
select p_partkey as k, cast(p_size + 5 as int) as total, cast(p_partkey % 13 + 4 as int) as tile,
       cast(p_partkey % 5 + 1 as int) as stride from part"""
cte("axis_sizes", SIZES)
cte("axis_offsets", """
select k, cast(0 as int) as o from axis_sizes where tile >= total
union
select k, cast(s.r * stride as int) from axis_sizes, (select range as r from range(80)) s
where tile < total and s.r * stride <= total - tile
union
select k, total - tile from axis_sizes where tile < total""")


@query("t1_tile_offsets", "select k, o from axis_offsets")
def _(spark, sf):
    return _sizes(spark, sf).select(
        "k", F.explode(tile_offsets("total", F.col("tile"), F.col("stride"))).alias("o")
    )


@query("t2_patch_grid", "select image_id, ty, tx from grid_sql")
def _(spark, sf):
    return tiling.patch_grid(view(spark, sf, "scenes"), PATCH, STRIDE)


# Scene 0 loses its top-left corner, so that a whole tile holds nothing but nodata.
def _holed(spark, sf):
    hole = (F.col("y") < 12) & (F.col("x") < 14)
    empty = F.transform("bands", lambda _: F.lit(-9999.0))
    return pixels(spark, sf).withColumn("bands", F.when(hole, empty).otherwise(F.col("bands")))


cte("tiles_sql", """
select s.image_id, cast(r.i as int) as tile_row, cast(c.j as int) as tile_col,
       cast(r.ty as int) as ty, cast(c.tx as int) as tx,
       'tile_' || lpad(cast(r.i as varchar), 3, '0') || '_' || lpad(cast(c.j as varchar), 3, '0')
         || '.tif' as tile_name
from scenes s, (values (0, 0), (1, 8), (2, 16), (3, 20)) r(i, ty),
     (values (0, 0), (1, 10), (2, 20), (3, 30), (4, 38)) c(j, tx)""")
cte("tile_hits", """
select t.*, bool_and(p.y < 12 and p.x < 14
                     or (p.b0 = -9999 and p.b1 = -9999 and p.b2 = -9999 and p.b3 = -9999)) as empty
from tiles_sql t join px p on p.image_id = t.image_id and p.y >= t.ty and p.y < t.ty + 10
 and p.x >= t.tx and p.x < t.tx + 12
group by all""")


@query("t3_tile_scenes", "select image_id, tile_row, tile_col, ty, tx, empty from tile_hits")
def _(spark, sf):
    tiles = tiling.tile_scenes(_holed(spark, sf), view(spark, sf, "scenes"), 12, 10, 2)
    return tiles.select("image_id", "tile_row", "tile_col", "ty", "tx", "empty")


@query("t4_tile_names", "select image_id, ty, tx, tile_name from tile_hits where not empty")
def _(spark, sf):
    tiles = tiling.tile_scenes(_holed(spark, sf), view(spark, sf, "scenes"), 12, 10, 2)
    return tiles.filter("written").select("image_id", "ty", "tx", "tile_name")


@query("t5_tile_summary", """
select image_id, count(*) filter (where not empty) as tiles, count(*) filter (where empty) as skipped,
       count(*) as total, 4 as rows, 5 as cols, 12 as tile_width, 10 as tile_height
from tile_hits group by image_id""")
def _(spark, sf):
    return tiling.tile_summary(
        tiling.tile_scenes(_holed(spark, sf), view(spark, sf, "scenes"), 12, 10, 2)
    )


@query("t6_tile_count", "select k, cast(count(*) as int) as n from axis_offsets group by k")
def _(spark, sf):
    return _sizes(spark, sf).select(
        "k", tile_count("total", F.col("tile"), F.col("stride")).alias("n")
    )


@query("t7_assign_patches", "select image_id, ty, tx, y, x, dy, dx from assigned_sql")
def _(spark, sf):
    return tiling.assign_patches(
        pixels(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE
    ).select("image_id", "ty", "tx", "y", "x", "dy", "dx")


@query("p7_window_transform", """
select g.image_id, g.ty, g.tx, s.tc + g.tx * s.ta + g.ty * s.tb as wc,
       s.tf + g.tx * s.td + g.ty * s.te as wf
from grid_sql g join scenes s using (image_id)""")
def _(spark, sf):
    from pixelframe.operators.normalize import window_transform

    scenes = view(spark, sf, "scenes")
    placed = window_transform(tiling.patch_grid(scenes, PATCH, STRIDE), scenes)
    return placed.select("image_id", "ty", "tx", "wc", "wf")


@query("t8_patch_assembly", """
select a.image_id, a.ty, a.tx, count(*) as pixels, round(min(n.n1), 9) as least_n1,
       round(max(n.n3) filter (where a.dy = 15 and a.dx = 15), 9) as last_n3
from assigned_sql a join npx n using (image_id, y, x) group by a.image_id, a.ty, a.tx""")
def _(spark, sf):
    patches = tiling.to_patches(
        tiling.assign_patches(normed(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE)
    )
    second = F.transform("data", lambda p: F.get(p, F.lit(1)))
    last = F.get(F.element_at("data", -1), F.lit(3))
    return patches.select(
        "image_id", "ty", "tx", F.size("data").cast("bigint").alias("pixels"),
        r(F.array_min(second)).alias("least_n1"), r(last).alias("last_n3"),
    )


@query("t9_patch_label_stats", """
select a.image_id, a.ty, a.tx,
       count(*) filter (where v.valid and m.label <> 255) as labeled_px,
       bool_or(v.valid and m.label = 0) as has_target
from assigned_sql a join fixed_masks m using (image_id, y, x) join vpx v using (image_id, y, x)
where not (m.y < 20 and m.x < 20)
group by a.image_id, a.ty, a.tx
having count(*) filter (where v.valid and m.label <> 255) > 0""")
def _(spark, sf):
    """Label statistics and the filter on them; a corner of every scene is left undrawn, invalid pixels are excluded."""
    valid = valid_px(spark, sf).select("image_id", "y", "x", "valid")
    rows = labels.collapse_labels(truth(spark, sf).join(valid, ["image_id", "y", "x"]))
    drawn = rows.filter(~((F.col("y") < 20) & (F.col("x") < 20))).withColumn("label", F.col("mask"))
    stats = tiling.patch_label_stats(
        tiling.assign_patches(drawn, view(spark, sf, "scenes"), PATCH, STRIDE)
    )
    grid = tiling.patch_grid(view(spark, sf, "scenes"), PATCH, STRIDE)
    return tiling.skip_unlabeled(grid, stats).join(stats, tiling.PATCH_KEY)


def _window_logits(spark, sf):
    """Fixture logits per window: each window adds its own small offset."""
    assigned = tiling.assign_patches(normed(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE)
    shift = 0.001 * (F.col("ty") - F.col("tx"))
    z = fixture_logits()
    return assigned.withColumn(
        "logits", F.array(F.get(z, 0) + shift, F.get(z, 1) - shift)
    )


cte("wz", """
select a.image_id, a.ty, a.tx, a.y, a.x, z.valid, z.z0 + 0.001 * (a.ty - a.tx) as w0,
       z.z1 - 0.001 * (a.ty - a.tx) as w1
from assigned_sql a join zpx z using (image_id, y, x)""")


@query("t10_blend_windows", """
select image_id, y, x, round(avg(w0), 9) as z0, round(avg(w1), 9) as z1
from wz group by image_id, y, x""")
def _(spark, sf):
    return tiling.blend(_window_logits(spark, sf)).select(
        "image_id", "y", "x",
        r(F.get("logits", 0)).alias("z0"), r(F.get("logits", 1)).alias("z1"),
    )


@query("i1_score_patches", """
select a.image_id, a.ty, a.tx, a.y, a.x, round(z.z0, 9) as z0, round(z.z1, 9) as z1
from assigned_sql a join zpx z using (image_id, y, x)""")
def _(spark, sf):
    patches = tiling.to_patches(
        tiling.assign_patches(normed(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE)
    )
    return scoring.score_patches(patches, fixture_model, PATCH).select(
        "image_id", "ty", "tx", "y", "x",
        r(F.get("logits", 0)).alias("z0"), r(F.get("logits", 1)).alias("z1"),
    )


@query("i2_softmax", "select image_id, y, x, round(p0, 9) as p0, round(p1, 9) as p1 from ppx")
def _(spark, sf):
    return predicted(spark, sf).select(
        "image_id", "y", "x",
        r(F.get("probs", 0)).alias("p0"), r(F.get("probs", 1)).alias("p1"),
    )


@query("i3_class_map", "select image_id, y, x, cls from ppx")
def _(spark, sf):
    return predicted(spark, sf).select("image_id", "y", "x", "cls")


@query("i4_target_prob", """
select image_id, y, x, case when valid then round(p0, 9) end as p_target from ppx""")
def _(spark, sf):
    return scoring.target_prob(predicted(spark, sf)).select(
        "image_id", "y", "x", r("p_target").alias("p_target")
    )


@query("i5_prediction_summary", """
select p.image_id, count(*) filter (where cls = 0) as target_pixels,
       count(*) filter (where valid) as valid_pixels, cast(18 as bigint) as tiles,
       any_value(s.width) as width, any_value(s.height) as height,
       count(*) filter (where cls = 0) / count(*) filter (where valid) as target_share
from ppx p join scenes s using (image_id) group by p.image_id""")
def _(spark, sf):
    scenes = view(spark, sf, "scenes")
    return scoring.prediction_summary(
        predicted(spark, sf), tiling.patch_grid(scenes, PATCH, STRIDE), scenes
    )


@query("i6_predict_scene", """
select image_id, y, x, cls, round(p0, 9) as p0 from ppx""")
def _(spark, sf):
    """Patches, model, blending: a per-pixel model must come back unchanged."""
    out = scoring.predict(pixels(spark, sf), view(spark, sf, "scenes"), fixture_model, PATCH)
    return out.select("image_id", "y", "x", "cls", r(F.get("probs", 0)).alias("p0"))


cte("around_sql", f"""
select a.image_id, a.ty, a.tx, a.y, a.x, sum(z.z0) / 9 as z0, sum(z.z1) / 9 as z1
from assigned_sql a join zpx z on z.image_id = a.image_id and abs(z.y - a.y) <= 1 and abs(z.x - a.x) <= 1
 and z.y between a.ty and a.ty + {PATCH - 1} and z.x between a.tx and a.tx + {PATCH - 1}
group by all""")


@query("i1_score_patches_neighbours", """
select image_id, ty, tx, y, x, round(z0, 9) as z0, round(z1, 9) as z1 from around_sql""")
def _(spark, sf):
    """A model that looks at neighbours: window edges show."""
    patches = tiling.to_patches(
        tiling.assign_patches(normed(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE)
    )
    return scoring.score_patches(patches, neighbour_model, PATCH).select(
        "image_id", "ty", "tx", "y", "x",
        r(F.get("logits", 0)).alias("z0"), r(F.get("logits", 1)).alias("z1"),
    )


@query("i6_predict_neighbours", """
select image_id, y, x, round(avg(z0), 6) as z0, round(avg(z1), 6) as z1 from around_sql group by image_id, y, x""")
def _(spark, sf):
    """Small blocks, so that their seams must not show."""
    scenes = view(spark, sf, "scenes")
    out = scoring.score_blocks(normed(spark, sf), scenes, neighbour_model, PATCH, STRIDE, block=1)
    return out.select(
        "image_id", "y", "x", r(F.get("logits", 0), 6).alias("z0"), r(F.get("logits", 1), 6).alias("z1")
    )


UNCERTAIN = """
select image_id, ty, tx, y, x, cast(rk as int) as rank from (
  select *, row_number() over (partition by image_id, ty, tx
            order by round(least(w0, w1) - greatest(w0, w1), 9) desc, y, x) as rk from wz)
where rk <= 16"""


@query("i7_uncertain_points", UNCERTAIN)
def _(spark, sf):
    return scoring.uncertain_points(_window_logits(spark, sf), PATCH).select(
        "image_id", "ty", "tx", "y", "x", "rank"
    )


@query("i8_refine_points", """
with chosen as (select image_id, ty, tx, y, x from (
  select *, row_number() over (partition by image_id, ty, tx
            order by round(least(w0, w1) - greatest(w0, w1), 9) desc, y, x) as rk from wz)
  where rk <= 16)
select w.image_id, w.ty, w.tx, w.y, w.x,
       round(case when c.y is null then w0 else w0 - w1 + n0 end, 9) as z0,
       round(case when c.y is null then w1 else w1 - w0 - n0 end, 9) as z1
from wz w left join chosen c using (image_id, ty, tx, y, x)
     join npx n on n.image_id = w.image_id and n.y = w.y and n.x = w.x""")
def _(spark, sf):
    """A toy point head: it sees one fine feature (band 0) and the coarse logits."""
    logits = _window_logits(spark, sf)
    points = scoring.uncertain_points(logits, PATCH).withColumn("fine", F.get("norm", 0))

    def head(frame):
        z = frame["logits"]
        frame["refined"] = [
            [a[0] - a[1] + f, a[1] - a[0] - f] for a, f in zip(z, frame["fine"])
        ]
        return frame

    columns = [*tiling.PATCH_KEY, "y", "x", "logits"]
    refined = scoring.refine(
        logits.select(*columns), points.select(*columns, "fine"), head
    )
    return refined.select(
        *tiling.PATCH_KEY, "y", "x",
        r(F.get("logits", 0)).alias("z0"), r(F.get("logits", 1)).alias("z1"),
    )


# A grid of vector lengths is read at fractional positions taken from events.
BILINEAR = """
with g as (select cast(gy as int) as gy, cast(gx as int) as gx, cast(vec[1] as double) as v
           from grid_vec),
shape as (select max(gy) + 1 as gh, 25 as gw from g),
pts as (select event_id, (event_id % 97) / 96.0 as u, (event_id * 31 % 89) / 88.0 as w from events),
spots as (select event_id, u * gh - 0.5 as fy, w * gw - 0.5 as fx from pts, shape),
corner as (select event_id, cast(floor(fy) as int) + a as gy, cast(floor(fx) as int) + b as gx,
             (case when a = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end)
             * (case when b = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as k
           from spots, (values (0), (1)) p(a), (values (0), (1)) q(b))
select event_id as point_id, round(sum(k * coalesce(v, 0)), 9) as value
from corner left join g using (gy, gx) group by event_id"""


def _grid_field(spark, sf):
    return view(spark, sf, "grid_vec").select(
        F.floor(F.col("vec_id") / 1_000_000_000).cast("int").alias("image_id"), "gy", "gx", F.get("vec", 0).cast("double").alias("v")
    )


def _grid_shape(spark, sf):
    return _grid_field(spark, sf).groupBy("image_id").agg(
        (F.max("gy") + 1).alias("gh"), (F.max("gx") + 1).alias("gw")
    )


@query("i9_sample_bilinear", BILINEAR)
def _(spark, sf):
    points = table(spark, sf, "events").select(
        F.floor(F.col("event_id") / 1_000_000_000).cast("int").alias("image_id"),
        F.col("event_id").alias("point_id"),
        ((F.col("event_id") % 97) / 96.0).alias("u"),
        ((F.col("event_id") * 31 % 89) / 88.0).alias("w"),
    )
    read = scoring.sample_bilinear(_grid_field(spark, sf), points, _grid_shape(spark, sf))
    return read.select("point_id", r("value").alias("value"))


RESIZE = """
with g as (select cast(gy as int) as gy, cast(gx as int) as gx, cast(vec[1] as double) as v
           from grid_vec),
shape as (select max(gy) + 1 as gh, 25 as gw from g),
pts as (select y.range as y, x.range as x from range(45) y, range(60) x),
spots as (select y, x, gh, gw, greatest((y + 0.5) / 45 * gh - 0.5, 0.0) as fy,
         greatest((x + 0.5) / 60 * gw - 0.5, 0.0) as fx from pts, shape),
corner as (select y, x, least(cast(floor(fy) as int) + a, gh - 1) as gy,
             least(cast(floor(fx) as int) + b, gw - 1) as gx,
             (case when a = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end)
             * (case when b = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as k
           from spots, (values (0), (1)) p(a), (values (0), (1)) q(b))
select cast(y as int) as y, cast(x as int) as x, round(sum(k * v), 9) as d
from corner join g using (gy, gx) group by y, x"""


@query("i10_resize_field", RESIZE)
def _(spark, sf):
    shape = _grid_shape(spark, sf).withColumn("height", F.lit(45)).withColumn("width", F.lit(60))
    lifted = scoring.resize_field(_grid_field(spark, sf), shape)
    return lifted.select("y", "x", r("d").alias("d"))
