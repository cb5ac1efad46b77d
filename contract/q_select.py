"""Similarity selection, regions and vector search."""

from pyspark.sql import functions as F

from pixelframe.operators import regions, selection

from .common import normed, r, truth
from .fixtures import view
from .registry import cte, query

PIXEL = ["image_id", "y", "x"]
TOLERANCE = 0.25
WIDE = 0.6
FEATURE_TOLERANCE = 0.8

# Window offsets nearest first: the first nine are the 3 x 3 neighbourhood.
cte("nine", "select a.range - 1 as dy, b.range - 1 as dx from range(3) a, range(3) b")
cte("near_nine", """
select c.sample_id, c.image_id, c.positive, c.y as sy, c.x as sx, p.valid,
       p.y = c.y and p.x = c.x as own, p.n0, p.n1, p.n2, p.n3
from clicks c, nine o, npx p
where p.image_id = c.image_id and p.y = c.y + o.dy and p.x = c.x + o.dx""")
cte("refs_sql", """
select sample_id, image_id, positive, sy as y, sx as x,
  coalesce(avg(n0) filter (where valid), max(n0) filter (where own)) as r0,
  coalesce(avg(n1) filter (where valid), max(n1) filter (where own)) as r1,
  coalesce(avg(n2) filter (where valid), max(n2) filter (where own)) as r2,
  coalesce(avg(n3) filter (where valid), max(n3) filter (where own)) as r3
from near_nine group by all""")
cte("fields_sql", """
select f.sample_id, f.positive, p.image_id, p.y, p.x, p.valid,
  sqrt(((p.n0 - r0) ** 2 + (p.n1 - r1) ** 2 + (p.n2 - r2) ** 2 + (p.n3 - r3) ** 2) / 4) as d
from npx p join refs_sql f using (image_id)""")
cte("matched_sql", """
select sample_id, image_id, y, x from fields_sql f
where positive and valid and d <= 0.25
  and d < (select min(d) from fields_sql g where not g.positive and g.image_id = f.image_id
           and g.y = f.y and g.x = f.x)
union
select sample_id, image_id, y, x from clicks where positive""")

cte("matched_wide", """
select sample_id, image_id, y, x from fields_sql f
where positive and valid and d <= 0.6
  and d < (select min(d) from fields_sql g where not g.positive and g.image_id = f.image_id
           and g.y = f.y and g.x = f.x)
union
select sample_id, image_id, y, x from clicks where positive""")


def _refs(spark, sf):
    return selection.reference(normed(spark, sf), view(spark, sf, "clicks"), 9)


def _fields(spark, sf):
    return selection.spectral_field(normed(spark, sf), _refs(spark, sf))


def _matched(spark, sf, tolerance=TOLERANCE):
    px, clicks = normed(spark, sf), view(spark, sf, "clicks")
    fields = selection.contested_field(px, selection.reference(px, clicks, 9), tolerance)
    return selection.match(fields, clicks, tolerance)


@query("w1_reference_vector", """
select sample_id, image_id, round(r0, 9) as r0, round(r1, 9) as r1, round(r2, 9) as r2,
       round(r3, 9) as r3 from refs_sql""")
def _(spark, sf):
    return _refs(spark, sf).select(
        "sample_id", "image_id", *[r(F.get("ref", i)).alias(f"r{i}") for i in range(4)]
    )


@query("w2_spectral_field", """
select sample_id, image_id, y, x, round(d, 9) as d from fields_sql""")
def _(spark, sf):
    return _fields(spark, sf).select("sample_id", *PIXEL, r("d").alias("d"))


# ---- vector grid ----

cte("vec_dims", """
select vec_id, gy, gx, i, cast(vec[i] as double) as v from grid_vec, (select unnest(range(1, 65)) as i)""")
cte("centred", """
select d.vec_id, d.gy, d.gx, d.i, d.v - m.m as c from vec_dims d
join (select i, avg(v) as m from vec_dims group by i) m using (i)""")
cte("unit_dims", """
select c.vec_id, c.gy, c.gx, c.i, c.c / greatest(l.len, 1e-8) as u from centred c
join (select vec_id, sqrt(sum(c * c)) as len from centred group by vec_id) l using (vec_id)""")
# Two clicks on a 120 x 100 scene over the grid: cell (gy, gx) = trunc(y / 120 * gh), trunc(x / 100 * 25).
cte("grid_clicks", """
select sample_id, positive, least(gh - 1, cast(floor(y / 120 * gh) as int)) as gy,
       least(24, cast(floor(x / 100 * 25) as int)) as gx
from (values (1, true, 61.0, 37.0), (2, true, 0.0, 99.0), (3, false, 100.0, 50.0)) c(sample_id, positive, y, x),
     (select max(gy) + 1 as gh from grid_vec)""")
cte("cell_refs", """
select sample_id, positive, i, m / greatest(sqrt(sum(m * m) over (partition by sample_id)), 1e-8) as ref
from (select c.sample_id, c.positive, u.i, avg(u.u) as m
      from grid_clicks c, nine o, unit_dims u
      where u.gy = c.gy + o.dy and u.gx = c.gx + o.dx group by c.sample_id, c.positive, u.i)""")
cte("cosine_sql", """
select r.sample_id, r.positive, u.gy, u.gx, 1 - sum(r.ref * u.u) as d
from unit_dims u join cell_refs r using (i) group by r.sample_id, r.positive, u.gy, u.gx""")


def _vectors(spark, sf):
    grid = view(spark, sf, "grid_vec")
    return grid.select(
        F.floor(F.col("vec_id") / 1_000_000_000).cast("int").alias("image_id"), "vec_id", "gy", "gx",
        F.col("vec").cast("array<double>").alias("vec"),
    )


def _grid_shape(spark, sf):
    return _vectors(spark, sf).groupBy("image_id").agg(
        (F.max("gy") + 1).alias("gh"), (F.max("gx") + 1).alias("gw"),
        F.lit(120).alias("height"), F.lit(100).alias("width"),
    )


def _grid_clicks(spark, sf):
    points = [(1, True, 61, 37), (2, True, 0, 99), (3, False, 100, 50)]
    rows = F.array(*[
        F.struct(F.lit(i).alias("sample_id"), F.lit(p).alias("positive"),
                 F.lit(y).alias("y"), F.lit(x).alias("x"))
        for i, p, y, x in points
    ])
    return _grid_shape(spark, sf).select("image_id", F.inline(rows))


@query("w3_center_unit", """
select vec_id, i, round(u, 9) as u from unit_dims""")
def _(spark, sf):
    unit = selection.center_unit(_vectors(spark, sf))
    return unit.select("vec_id", F.posexplode("unit").alias("p", "v")).select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("i"), r("v").alias("u")
    )


def _cosine(spark, sf):
    return selection.cosine_field(
        selection.center_unit(_vectors(spark, sf)), _grid_clicks(spark, sf),
        _grid_shape(spark, sf), 9,
    )


@query("w4_cosine_field", "select sample_id, gy, gx, round(d, 9) as d from cosine_sql")
def _(spark, sf):
    return _cosine(spark, sf).select("sample_id", "gy", "gx", r("d").alias("d"))


@query("w4_cosine_field_upsampled", """
with pts as (select y.range as y, x.range as x from range(120) y, range(100) x),
spots as (select y, x, gh, greatest((y + 0.5) / 120 * gh - 0.5, 0.0) as fy,
         greatest((x + 0.5) / 100 * 25 - 0.5, 0.0) as fx
       from pts, (select max(gy) + 1 as gh from grid_vec)),
corner as (select y, x, least(cast(floor(fy) as int) + a, gh - 1) as gy,
             least(cast(floor(fx) as int) + b, 24) as gx,
             (case when a = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end)
             * (case when b = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as k
           from spots, (values (0), (1)) p(a), (values (0), (1)) q(b))
select sample_id, cast(y as int) as y, cast(x as int) as x, round(sum(k * d), 9) as d
from corner join cosine_sql using (gy, gx) group by sample_id, y, x""")
def _(spark, sf):
    fields = _cosine(spark, sf)
    lifted = selection.upsample_fields(fields, _grid_shape(spark, sf))
    return lifted.select("sample_id", "y", "x", r("d").alias("d"))


@query("w5_match_set", "select sample_id, image_id, y, x from matched_sql")
def _(spark, sf):
    return _matched(spark, sf)


cte("walk", """
select c.sample_id, c.image_id, c.y, c.x from clicks c where c.positive
union
select w.sample_id, w.image_id, m.y, m.x from walk w join matched_wide m
  on m.sample_id = w.sample_id and m.image_id = w.image_id
 and abs(m.y - w.y) + abs(m.x - w.x) = 1""")


@query("w6_connected_region", "select sample_id, image_id, y, x from walk", recursive=True)
def _(spark, sf):
    seeds = view(spark, sf, "clicks").filter("positive")
    return regions.region_of(_matched(spark, sf, WIDE), seeds, block=16)


# Depth-limited walk: every (pixel, depth) pair up to a bound above the longest path needed.
@query("w7_grow_budget", """
with matched_now as materialized (select * from matched_wide),
steps as (
  select sample_id, image_id, y, x, 0 as depth from clicks where positive
  union
  select s.sample_id, s.image_id, m.y, m.x, s.depth + 1 from steps s join matched_now m
    on m.sample_id = s.sample_id and m.image_id = s.image_id
   and abs(m.y - s.y) + abs(m.x - s.x) = 1
  where s.depth < 60),
firsts as (select sample_id, image_id, y, x, min(depth) as depth from steps group by all),
ranked as (select *, row_number() over (partition by sample_id order by depth, y, x) as rk from firsts)
select sample_id, image_id, y, x, cast(depth as bigint) as dist from ranked where rk <= 40""",
       recursive=True)
def _(spark, sf):
    seeds = view(spark, sf, "clicks").filter("positive")
    return regions.grow(_matched(spark, sf, WIDE), seeds, 40, block=16)


@query("w8_nearest_budget", """
select sample_id, image_id, y, x, cast(d2 as bigint) as d2 from (
  select m.*, (m.y - c.y) ** 2 + (m.x - c.x) ** 2 as d2,
         row_number() over (partition by m.sample_id
           order by (m.y - c.y) ** 2 + (m.x - c.x) ** 2, m.y, m.x) as rk
  from matched_sql m join clicks c using (sample_id))
where rk <= 40""")
def _(spark, sf):
    seeds = view(spark, sf, "clicks").filter("positive")
    return selection.nearest(_matched(spark, sf), seeds, 40).select("sample_id", *PIXEL, "d2")


def _select(spark, sf, tolerance=TOLERANCE, **options):
    return selection.select(
        normed(spark, sf), view(spark, sf, "clicks"), view(spark, sf, "scenes"), tolerance,
        sample_size=9, **options,
    )


@query("w9_select_global", """
select distinct image_id, y, x from (
  select m.*, row_number() over (partition by m.sample_id
           order by (m.y - c.y) ** 2 + (m.x - c.x) ** 2, m.y, m.x) as rk
  from matched_sql m join clicks c using (sample_id))
where rk <= 200""")
def _(spark, sf):
    return _select(spark, sf, is_global=True, budget=200).pixels


@query("w9_select_connected", "select distinct image_id, y, x from walk", recursive=True)
def _(spark, sf):
    return _select(spark, sf, WIDE).pixels


@query("w10_protect_and_stats", """
with kept as (select distinct m.image_id, m.y, m.x from matched_sql m),
held as (select k.* from kept k join fixed_masks f using (image_id, y, x) where f.label <> 255)
select (select count(*) from kept) - (select count(*) from held) as count,
       (select count(*) from kept) as available, (select count(*) from held) as protected, false as capped,
       (select count(*) from vpx where valid) as valid,
       (select count(*) from kept) - (select count(*) from held)
         > 0.4 * (select count(*) from vpx where valid) as large""")
def _(spark, sf):
    return _select(spark, sf, is_global=True, protect=truth(spark, sf)).stats


# ---- selection by features: a grid of 4 x 25 vectors on every scene they reach ----

cte("feature_dims", """
select cast(floor(vec_id / 100) as int) as image_id, cast(floor(vec_id % 100 / 25) as int) as gy,
       cast(vec_id % 25 as int) as gx, i, cast(embedding[i] as double) as v
from embeddings, (select unnest(range(1, 65)) as i)""")
cte("feature_units", """
select image_id, gy, gx, i, c / greatest(sqrt(sum(c * c) over (partition by image_id, gy, gx)), 1e-8) as u
from (select *, v - avg(v) over (partition by image_id, i) as c from feature_dims)""")
cte("feature_refs", """
select sample_id, positive, image_id, i, m / greatest(sqrt(sum(m * m) over (partition by sample_id)), 1e-8) as ref
from (select c.sample_id, c.positive, c.image_id, u.i, avg(u.u) as m
      from clicks c, nine o, feature_units u
      where u.image_id = c.image_id and u.gy = least(3, cast(floor(c.y / 30 * 4) as int)) + o.dy
        and u.gx = least(24, cast(floor(c.x / 50 * 25) as int)) + o.dx
      group by c.sample_id, c.positive, c.image_id, u.i)""")
cte("feature_d", """
select r.sample_id, r.positive, r.image_id, u.gy, u.gx, 1 - sum(r.ref * u.u) as d
from feature_units u join feature_refs r using (image_id, i)
group by r.sample_id, r.positive, r.image_id, u.gy, u.gx""")
cte("feature_corners", """
select cast(y as int) as y, cast(x as int) as x, least(cast(floor(fy) as int) + a, 3) as gy, least(cast(floor(fx) as int) + b, 24) as gx,
       (case when a = 1 then fy - floor(fy) else 1 - (fy - floor(fy)) end)
       * (case when b = 1 then fx - floor(fx) else 1 - (fx - floor(fx)) end) as k
from (select y.range as y, x.range as x, greatest((y.range + 0.5) / 30 * 4 - 0.5, 0.0) as fy,
             greatest((x.range + 0.5) / 50 * 25 - 0.5, 0.0) as fx from range(30) y, range(50) x),
     (values (0), (1)) p(a), (values (0), (1)) q(b)""")
cte("feature_fields", """
select sample_id, positive, image_id, y, x, sum(k * d) as d
from feature_corners join feature_d using (gy, gx) group by sample_id, positive, image_id, y, x""")
cte("feature_matched", f"""
select f.sample_id, f.image_id, f.y, f.x
from feature_fields f join vpx v using (image_id, y, x)
left join (select image_id, y, x, min(d) as d_neg from feature_fields where not positive group by all) n
  using (image_id, y, x)
where f.positive and v.valid and f.d <= {FEATURE_TOLERANCE} and (n.d_neg is null or f.d < n.d_neg)
union
select sample_id, image_id, y, x from clicks where positive""")


@query("w9_select_by_features", """
with ranked as (
  select m.*, row_number() over (partition by m.sample_id
           order by (m.y - c.y) ** 2 + (m.x - c.x) ** 2, m.y, m.x) as rk
  from feature_matched m join clicks c using (sample_id)),
kept as (select distinct image_id, y, x from ranked where rk <= 150)
select image_id, y, x from kept
where not exists (select 1 from fixed_masks f where f.label <> 255 and f.image_id = kept.image_id
                  and f.y = kept.y and f.x = kept.x)""")
def _(spark, sf):
    """Distances on the features of one level, lifted to pixels, cut to a budget; drawn pixels are withheld."""
    every = view(spark, sf, "grid_vec").select(
        F.floor(F.col("vec_id") / 100).cast("int").alias("image_id"), F.lit("fine").alias("level"),
        F.floor(F.col("vec_id") % 100 / 25).cast("int").alias("gy"), (F.col("vec_id") % 25).cast("int").alias("gx"),
        F.col("vec").cast("array<double>").alias("vec"), F.lit(4).alias("gh"), F.lit(25).alias("gw"),
    )
    deep = every.filter("gy < 2").withColumns({"level": F.lit("deep"), "gh": F.lit(2)})
    return _select(
        spark, sf, FEATURE_TOLERANCE, is_global=True, budget=150, protect=truth(spark, sf),
        source="sam", level="fine", features=every.unionByName(deep),
    ).pixels


# ---- components of the bright pixels of every scene ----

cte("bright", "select image_id, y, x from npx where n0 > 0.35")


def _bright(spark, sf):
    return normed(spark, sf).filter(F.get("norm", 0) > 0.35).select(*PIXEL)


# Minimum propagation: every pixel takes the least label among its neighbours until none changes.
LABELLED = """with lab(image_id, y, x, component) using key (image_id, y, x) as (
  select image_id, y, x, cast(y as bigint) * 2147483648 + x from bright
  union
  select l.image_id, l.y, l.x, min(n.component)
  from recurring.lab l join lab n on n.image_id = l.image_id and abs(n.y - l.y) + abs(n.x - l.x) = 1
  where n.component < l.component
  group by l.image_id, l.y, l.x)
"""


@query("w11_components", LABELLED + "select image_id, y, x, component from lab", recursive=True)
def _(spark, sf):
    labelled = regions.components(_bright(spark, sf), block=16)
    return labelled.select(*PIXEL, "component")


@query("w12_region_statistics", LABELLED + """, touching as (
  select l.image_id, l.y, l.x, l.component, count(n.y) as touches
  from lab l left join lab n on n.image_id = l.image_id and abs(n.y - l.y) + abs(n.x - l.x) = 1
  group by all)
select image_id, component, count(*) as area, min(y) as y_min, max(y) as y_max, min(x) as x_min, max(x) as x_max,
       avg(y) as y_mean, avg(x) as x_mean, cast(sum(4 - touches) as bigint) as exposed
from touching group by image_id, component having count(*) >= 16""", recursive=True)
def _(spark, sf):
    labelled = regions.components(_bright(spark, sf), block=16)
    return regions.regions(labelled, min_area=16)


@query("w13_selection_edges", """
with n4 as (select * from (values (-1, 0), (1, 0), (0, -1), (0, 1)) v(dy, dx)),
cells as (select p.image_id, p.y, p.x, b.y is not null as is_on
          from px p left join bright b using (image_id, y, x)),
around as (select c.image_id, c.y, c.x, c.is_on, count(b.y) as touches
           from cells c cross join n4 left join bright b
             on b.image_id = c.image_id and b.y = c.y + n4.dy and b.x = c.x + n4.dx
           group by all)
select image_id, y, x, case when is_on then 'inner' else 'outer' end as edge
from around where (is_on and touches < 4) or (not is_on and touches > 0)""")
def _(spark, sf):
    return selection.edges(_bright(spark, sf), view(spark, sf, "scenes"))


# ---- vector search ----

cte("examples", """
select vec_id, label = 3 as positive from embeddings where label in (3, 7) and vec_id % 10 < 4""")
cte("pair_d", """
select u.vec_id, e.positive, 1 - sum(u.u * r.u) as d
from unit_dims u join unit_dims r using (i) join examples e on e.vec_id = r.vec_id
group by u.vec_id, r.vec_id, e.positive""")


@query("w14_vector_search", """
select vec_id, round(min(d) filter (where positive), 9) as d, round(min(d) filter (where not positive), 9) as d_neg
from pair_d group by vec_id
having min(d) filter (where positive) <= 0.9 and min(d) filter (where positive) < min(d) filter (where not positive)
order by min(d) filter (where positive), vec_id limit 50""")
def _(spark, sf):
    vectors = view(spark, sf, "grid_vec").select(
        "vec_id", "label", F.col("vec").cast("array<double>").alias("vec")
    )
    examples = vectors.filter("label in (3, 7) and vec_id % 10 < 4").select(
        "vec_id", (F.col("label") == 3).alias("positive")
    )
    found = selection.similar(vectors, examples, 0.9, 50)
    return found.select("vec_id", r("d").alias("d"), r("d_neg").alias("d_neg"))
