"""Scene tables and per-pixel projections."""

from pyspark.sql import functions as F

from pixelframe.operators import normalize, scoring
from pixelframe.session import cut
from pixelframe.sources import scenes as scene_source
from pixelframe.sources import tables

from .common import normed, predicted, r, roles, truth, valid_px
from .fixtures import pixels, view
from .registry import query


@query("s3_band_probe", """
select (select band_count from scenes where band_count is not null order by name limit 1)
  as band_count""")
def _(spark, sf):
    return scene_source.probe_bands(view(spark, sf, "scenes"))


@query("s4_scene_validation", """
select name, band_count is null as unreadable, coalesce(band_count <> 4, false) as wrong_bands,
       least(height, width) < 32 as too_small
from scenes""")
def _(spark, sf):
    checked = scene_source.validate_scenes(view(spark, sf, "scenes"), 4, 32)

    def has(text):
        return F.exists("errors", lambda e: F.contains(e, F.lit(text)))

    return checked.select(
        "name", has("unreadable").alias("unreadable"), has("expected").alias("wrong_bands"),
        has("smaller than").alias("too_small"),
    )


@query("s6_mask_fit", """
with meta as (select name, case when image_id % 3 = 2 then 31 else 30 end as height, 50 as width
              from scenes)
select m.name, s.name is not null as usable
from meta m left join scenes s
  on s.name = m.name and s.height = m.height and s.width = m.width and s.band_count = 4""")
def _(spark, sf):
    scenes = view(spark, sf, "scenes")
    height = F.when(F.col("image_id") % 3 == 2, 31).otherwise(30)
    meta = scenes.select("name", height.alias("height"), "width")
    usable, stale = scene_source.fit_masks(meta, scenes, 4)
    return usable.select("name", F.lit(True).alias("usable")).unionByName(
        stale.select("name", F.lit(False).alias("usable"))
    )


def _session_labels(spark, sf):
    """Unsaved labels: scenes 0, 3, 6, ... redrawn in this session, scene 3 wiped."""
    rows = truth(spark, sf).filter(F.col("image_id") % 3 == 0)
    return rows.withColumn(
        "label", F.when(F.col("image_id") == 3, 255).when(F.col("x") % 2 == 0, F.col("label"))
        .otherwise(255)
    )


@query("s7_labeled_samples", """
with session as (select image_id, y, x,
                   case when image_id = 3 then 255 when x % 2 = 0 then label else 255 end as label
                 from fixed_masks where image_id % 3 = 0),
merged as (select image_id, label, 'session' as origin from session
           union all select image_id, label, 'saved' from fixed_masks
           where image_id not in (select image_id from session)),
counted as (select image_id, origin, count(*) filter (where label <> 255) as labeled_px
            from merged group by image_id, origin)
select c.image_id, s.name, c.origin, e.role, c.labeled_px
from counted c join scenes s using (image_id) join eff_split e on e.name = s.name
where c.labeled_px > 0""")
def _(spark, sf):
    return tables.labeled_samples(
        truth(spark, sf), _session_labels(spark, sf), roles(spark, sf), view(spark, sf, "scenes")
    )


@query("p1_valid_mask", "select image_id, y, x, valid from vpx")
def _(spark, sf):
    return valid_px(spark, sf).select("image_id", "y", "x", "valid")


@query("p2_band_stats", "select image_id, band, round(lo, 6) as lo, round(hi, 6) as hi from bandstat")
def _(spark, sf):
    stats = normalize.band_stats(valid_px(spark, sf))
    return stats.select("image_id", "band", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


@query("p2_band_stats_large_scenes",
       "select image_id, band, round(lo, 6) as lo, round(hi, 6) as hi from bandstat")
def _(spark, sf):
    """The distributed exact path, forced for every scene."""
    stats = normalize.band_stats(valid_px(spark, sf))
    return stats.select("image_id", "band", r("lo", 6).alias("lo"), r("hi", 6).alias("hi"))


@query("p2b_approximate_stats", """
with q as (
  select image_id, band, quantile_disc(v, 0.02) as lo, quantile_disc(v, 0.98) as hi from (
    select image_id, unnest([0, 1, 2, 3]) as band, unnest([b0, b1, b2, b3]) as v from vpx where valid)
  group by image_id, band)
select image_id, cast(band as int) as band, lo, case when hi <= lo then lo + 1 else hi end as hi from q""")
def _(spark, sf):
    return normalize.band_stats(valid_px(spark, sf), approx=True)


SKETCH = 512


@query("p2b_merged_sets", """
select s.set_id, l.band, count(*) filter (where l.valid) as n, true as lo_holds, true as hi_holds
from lpx l join (select image_id, image_id % 3 as set_id from scenes
                 union all select image_id, 9 from scenes) s on l.image_id = s.image_id
group by s.set_id, l.band""")
def _(spark, sf):
    """Percentiles of sets of scenes from stored sketches; the pixels only tell how far their ranks are off."""
    px, scenes = valid_px(spark, sf), view(spark, sf, "scenes").select("image_id")
    sets = scenes.withColumn("set_id", F.col("image_id") % 3).unionByName(scenes.withColumn("set_id", F.lit(9)))
    stats = normalize.merged_stats(cut(normalize.scene_sketches(px, SKETCH)), sets)
    values = px.filter("valid").select("image_id", F.posexplode("bands").alias("band", "v")).join(sets, "image_id")
    ranks = values.join(stats, ["set_id", "band"]).groupBy("set_id", "band", "n").agg(*[
        F.struct((F.count_if(F.col("v") < F.col(p)) / F.first("n")).alias("low"),
                 (F.count_if(F.col("v") <= F.col(p)) / F.first("n")).alias("high")).alias(p) for p in ("lo", "hi")
    ])
    slack = 3 * normalize.rank_error(SKETCH)
    holds = lambda p, share: (F.col(p)["low"] <= share + slack) & (F.col(p)["high"] >= share - slack)
    return ranks.select("set_id", "band", "n", holds("lo", 0.02).alias("lo_holds"), holds("hi", 0.98).alias("hi_holds"))


@query("p3_normalize", """
select image_id, y, x, round(n0, 9) as n0, round(n1, 9) as n1, round(n2, 9) as n2,
       round(n3, 9) as n3 from npx""")
def _(spark, sf):
    return normed(spark, sf).select(
        "image_id", "y", "x", *[r(F.get("norm", i)).alias(f"n{i}") for i in range(4)]
    )


@query("p4_band_mapping", """
select image_id, y, x, b2 as c0, b0 as c1, b3 as c2, cast(-1 as double) as nodata from px""")
def _(spark, sf):
    picked = normalize.select_bands(pixels(spark, sf), 3, 4, [3, 1, 4], source_nodata=-1)
    return picked.select(
        "image_id", "y", "x", *[F.get("bands", i).alias(f"c{i}") for i in range(3)], "nodata"
    )


@query("p5_rgb_composite", """
select image_id, y, x, case when valid then cast(floor(n3 * 255) as int) else 0 end as red,
       case when valid then cast(floor(n1 * 255) as int) else 0 end as green,
       case when valid then cast(floor(n0 * 255) as int) else 0 end as blue from npx""")
def _(spark, sf):
    rgb = normalize.rgb_composite(normed(spark, sf), 4, [9, 1, -2])
    return rgb.select("image_id", "y", "x", "red", "green", "blue")


@query("p6_bands_long", """
select image_id, y, x, band, v as value, 'Band ' || cast(band + 1 as varchar) as band_name
from lpx""")
def _(spark, sf):
    return normalize.bands_long(pixels(spark, sf), 4)


@query("p7_world_xy", """
select p.image_id, p.y, p.x, s.tc + (p.x + 0.5) * s.ta + (p.y + 0.5) * s.tb as world_x,
       s.tf + (p.x + 0.5) * s.td + (p.y + 0.5) * s.te as world_y
from px p join scenes s using (image_id)""")
def _(spark, sf):
    world = normalize.with_world_xy(pixels(spark, sf), view(spark, sf, "scenes"))
    return world.select("image_id", "y", "x", "world_x", "world_y")


# Overview: 30 x 50 scaled to a longest side of 12 gives 7 x 12 cells (29.999.. / rint on both).
OVERVIEW = """
with cells as (
  select p.*, oy.oy, ox.ox,
         (least((p.y + 1) * 7 / 30.0, oy.oy + 1) - greatest(p.y * 7 / 30.0, oy.oy))
         * (least((p.x + 1) * 12 / 50.0, ox.ox + 1) - greatest(p.x * 12 / 50.0, ox.ox)) as w
  from px p
  join (select range as oy from range(7)) oy
    on oy.oy < (p.y + 1) * 7 / 30.0 - 1e-12 and oy.oy + 1 > p.y * 7 / 30.0 + 1e-12
  join (select range as ox from range(12)) ox
    on ox.ox < (p.x + 1) * 12 / 50.0 - 1e-12 and ox.ox + 1 > p.x * 12 / 50.0 + 1e-12),
means as (
  select image_id, oy as y, ox as x,
         sum(w * b0) filter (where b0 <> -9999) / sum(w) filter (where b0 <> -9999) as m0,
         sum(w * b1) filter (where b1 <> -9999) / sum(w) filter (where b1 <> -9999) as m1,
         sum(w * b2) filter (where b2 <> -9999) / sum(w) filter (where b2 <> -9999) as m2
  from cells group by image_id, oy, ox),
v as (select *, m0 is not null and m1 is not null and m2 is not null as ok from means),
st as (select image_id,
         quantile_cont(m0, 0.02) filter (where ok) l0, quantile_cont(m0, 0.98) filter (where ok) h0,
         quantile_cont(m1, 0.02) filter (where ok) l1, quantile_cont(m1, 0.98) filter (where ok) h1,
         quantile_cont(m2, 0.02) filter (where ok) l2, quantile_cont(m2, 0.98) filter (where ok) h2
       from v group by image_id)
select image_id, cast(y as int) as y, cast(x as int) as x,
  case when ok then cast(floor(least(greatest((m0 - l0) / (h0 - l0), 0), 1) * 255) as int) else 0 end as red,
  case when ok then cast(floor(least(greatest((m1 - l1) / (h1 - l1), 0), 1) * 255) as int) else 0 end as green,
  case when ok then cast(floor(least(greatest((m2 - l2) / (h2 - l2), 0), 1) * 255) as int) else 0 end as blue
from v join st using (image_id)"""


@query("p8_overview", OVERVIEW)
def _(spark, sf):
    small = normalize.downsample(pixels(spark, sf), view(spark, sf, "scenes"), 4, size=12)
    return small.select("image_id", "y", "x", "red", "green", "blue")


@query("p10_uncertainty", """
select image_id, y, x, round(1 - greatest(p0, p1), 9) as uncertainty,
       case when valid then cast(floor(least(greatest((1 - greatest(p0, p1)) * 2 * 255, 0), 255))
                                 as int) else 0 end as alpha
from ppx""")
def _(spark, sf):
    return scoring.uncertainty(predicted(spark, sf)).select(
        "image_id", "y", "x", r("uncertainty").alias("uncertainty"), "alpha"
    )
