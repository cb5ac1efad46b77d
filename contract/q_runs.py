"""Training-set construction, learning, run monitoring, catalog upkeep and streams."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelframe.operators import augment, learn, monitor, tiling
from pixelframe.session import ensure_checkpoint_dir
from pixelframe.sources import tables
from pixelframe.streaming import edits as edit_stream
from pixelframe.streaming import gate as gate_stream
from pixelframe.streaming import state as label_state

from .common import PATCH, STRIDE, normed, predicted, r, roles, scored, truth
from .fixtures import view
from .registry import cte, query

SEED, EPOCH = 7, 3
PIXEL = ["image_id", "y", "x"]


def scratch(spark) -> str:
    """A new folder inside the session's checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


# ---- random numbers in SQL: the same integer arithmetic, written out ----


def mixed_sql(*parts) -> str:
    head, parts = 1, list(parts)
    while isinstance(parts[0], int):
        head = (head * 1583458089 + parts.pop(0) + 1) % 2147483647
        head = (head * head + 1013904223) % 2147483647
    h = f"cast({head} as bigint)"
    for part in parts:
        h = f"(({h} * 1583458089 + cast({part} as bigint) + 1) % 2147483647)"
    h = f"(({h} * {h} + 12345) % 2147483647)"
    h = f"(({h} * 784588716 + 1) % 2147483629)"
    return f"(({h} * 1583458089 + 1) % 2147483647)"


def u_sql(purpose, *extra) -> str:
    parts = (SEED, EPOCH, purpose, "image_id", "ty", "tx", *extra)
    return f"(cast({mixed_sql(*parts)} as double) / 2147483647.0)"


def below_sql(bound, purpose, *extra) -> str:
    return f"cast(floor({u_sql(purpose, *extra)} * ({bound})) as int)"


def span_sql(low, high, purpose) -> str:
    return f"({low} + {u_sql(purpose)} * ({high} - {low}))"


def _grid(spark, sf):
    return tiling.patch_grid(view(spark, sf, "scenes"), PATCH, STRIDE)


@query("a1_epoch_order", f"""
select image_id, ty, tx, image_order, cast(row_number() over w as bigint) as position,
       cast(floor((row_number() over w - 1) / 4) as int) as batch
from (select *, {mixed_sql(SEED, EPOCH, augment.ORDER_IMAGE, 'image_id')} as image_order,
        {mixed_sql(SEED, EPOCH, augment.ORDER_PATCH, 'image_id', 'ty', 'tx')} as po from grid_sql) t
window w as (partition by image_id order by po, ty, tx)""")
def _(spark, sf):
    return augment.epoch_order(_grid(spark, sf), SEED, EPOCH)


cte("turned", f"""
select image_id, ty, tx, y, x, {u_sql(augment.FLIP_H)} < 0.5 as fh, {u_sql(augment.FLIP_V)} < 0.5 as fv,
  case when {u_sql(augment.ROTATE)} < 0.5 then {below_sql(4, augment.ROTATE_BY)} else 0 end as t, dy, dx
from assigned_sql""")


@query("a2_geometric_views", """
with f as (select *, case when fv then 15 - dy else dy end as r, case when fh then 15 - dx else dx end as c
           from turned)
select image_id, ty, tx, y, x,
       case t when 0 then r when 1 then 15 - c when 2 then 15 - r else c end as dy,
       case t when 0 then c when 1 then r when 2 then 15 - c else 15 - r end as dx
from f""")
def _(spark, sf):
    pixels = tiling.assign_patches(
        normed(spark, sf).select(*PIXEL), view(spark, sf, "scenes"), PATCH, STRIDE
    )
    return augment.augment_weak(pixels, PATCH, SEED, EPOCH).select(
        "image_id", "ty", "tx", "y", "x", "dy", "dx"
    )


A = augment
cte("strong_sql", f"""
select image_id, ty, tx, {u_sql(A.NOISE)} < 0.8 as noisy, {span_sql(0.01, 0.05, A.NOISE_LEVEL)} as std,
  {u_sql(A.LIGHT)} < 0.8 as lit, 1 + {span_sql(-0.2, 0.2, A.CONTRAST)} as contrast,
  {span_sql(-0.2, 0.2, A.BRIGHTNESS)} as brightness, {u_sql(A.DROP)} < 0.15 as drops,
  {below_sql(4, A.DROP_FIRST)} as one, ({below_sql(4, A.DROP_FIRST)} + 1 + {below_sql(3, A.DROP_SECOND)}) % 4 as other,
  {below_sql(2, A.DROP_COUNT)} = 1 as two from grid_sql""")
cte("holes_sql", f"""
select image_id, ty, tx, hh, hw, {below_sql('16 - hh + 1', A.HOLE_Y, 'k')} as top,
       {below_sql('16 - hw + 1', A.HOLE_X, 'k')} as lft
from (select image_id, ty, tx, k, least(16, 4 + {below_sql(21, A.HOLE_H, 'k')}) as hh,
        least(16, 4 + {below_sql(21, A.HOLE_W, 'k')}) as hw
      from grid_sql, (select range as k from range(6))
      where {u_sql(A.HOLES)} < 0.5 and k <= {below_sql(6, A.HOLE_COUNT)})""")


def strong_sql(band: int) -> str:
    size, angle = (u_sql(p, "dy", "dx", band) for p in (A.NOISE_SIZE, A.NOISE_ANGLE))
    noise = f"sqrt(-2 * ln(1 - {size})) * cos(2 * pi() * {angle})"
    noised = f"case when noisy then greatest(0, least(1, n{band} + std * {noise})) else n{band} end"
    lit = f"case when lit then greatest(0, least(1, ({noised}) * contrast + brightness)) else {noised} end"
    dropped = f"drops and ({band} = one or (two and {band} = other))"
    return f"round(case when holed or ({dropped}) then 0 else {lit} end, 9) as n{band}"


@query("a3_photometric_views", f"""
with p as (select a.image_id, a.ty, a.tx, a.y, a.x, a.dy, a.dx, n.n0, n.n1, n.n2, n.n3, s.* exclude (image_id, ty, tx),
        exists (select 1 from holes_sql h where h.image_id = a.image_id and h.ty = a.ty and h.tx = a.tx
                and a.dy between top and top + hh - 1 and a.dx between lft and lft + hw - 1) as holed
  from assigned_sql a join npx n on n.image_id = a.image_id and n.y = a.y and n.x = a.x
  join strong_sql s on s.image_id = a.image_id and s.ty = a.ty and s.tx = a.tx)
select image_id, ty, tx, y, x, {", ".join(strong_sql(b) for b in range(4))} from p""")
def _(spark, sf):
    pixels = tiling.assign_patches(normed(spark, sf), view(spark, sf, "scenes"), PATCH, STRIDE)
    plan = augment.strong_plan(_grid(spark, sf), PATCH, 4, SEED, EPOCH)
    strong = augment.augment_strong(pixels, plan, 4, SEED, EPOCH)
    return strong.select(
        "image_id", "ty", "tx", "y", "x", *[r(F.get("norm", i)).alias(f"n{i}") for i in range(4)]
    )


def _masked(spark, sf):
    """Dense pixels with the training mask: labels only in the right half of each scene."""
    label = F.when(F.col("x") >= 25, F.col("label")).otherwise(255)
    rows = normed(spark, sf).join(truth(spark, sf), PIXEL)
    mask = F.when(~F.col("valid"), 254).otherwise(label)
    return rows.select(*PIXEL, "norm", mask.alias("mask"))


cte("mask_px", """
select image_id, y, x, n0, case when not valid then 254 when x >= 25 then label else 255 end as mask
from judged""")
SLOTS = ", ".join(f"({s}, {k})" for s in (1, 2, 3, 4, 5) for k in range(8))
cte("tries_any", f"""
select image_id, ty, tx, slot, {below_sql('30 - 16 + 1', augment.DONOR_Y, 'slot', 'k')} as oy,
       {below_sql('50 - 16 + 1', augment.DONOR_X, 'slot', 'k')} as ox, k
from grid_sql, (values {SLOTS}) s(slot, k)""")
cte("tries", """
select t.*, (select count(*) from mask_px m where m.image_id = t.image_id and m.y between t.oy and t.oy + 15
               and m.x between t.ox and t.ox + 15 and m.mask < 254) as labeled_px,
            (select count(*) from mask_px m where m.image_id = t.image_id and m.y between t.oy and t.oy + 15
               and m.x between t.ox and t.ox + 15 and m.mask = 0) as target_px
from tries_any t""")
cte("donors_any", "select image_id, ty, tx, slot, oy, ox from tries_any where k = 0 and slot < 5")
cte("donors_target", """
select image_id, ty, tx, slot, oy, ox from (
  select *, row_number() over (partition by image_id, ty, tx, slot order by k) as rk
  from tries where slot = 5 and target_px > 0) where rk = 1""")


@query("a4_donor_windows", """
select image_id, ty, tx, slot, oy, ox from (
  select *, row_number() over (partition by image_id, ty, tx, slot order by k) as rk
  from tries where slot < 5 and labeled_px > 60) where rk = 1""")
def _(spark, sf):
    integral = augment.label_integral(_masked(spark, sf), view(spark, sf, "scenes"))
    return augment.donors(
        _grid(spark, sf), view(spark, sf, "scenes"), PATCH, (1, 2, 3, 4), SEED, EPOCH,
        F.col("labeled_px") > 60, integral,
    )


cte("plan_sql", f"""
select g.image_id, g.ty, g.tx, {u_sql(augment.MOSAIC)} < 0.2 as m_on, 4 + {below_sql(9, augment.SPLIT_Y)} as sy,
  4 + {below_sql(9, augment.SPLIT_X)} as sx, {u_sql(augment.CUTMIX)} < 0.2 as c_on,
  least(16, greatest(1, cast(round_even(sqrt({span_sql(0.05, 0.35, augment.BOX_AREA)} * 256 / {span_sql(0.5, 2.0, augment.BOX_ASPECT)}), 0) as int))) as bh,
  least(16, greatest(1, cast(round_even(sqrt({span_sql(0.05, 0.35, augment.BOX_AREA)} * 256 * {span_sql(0.5, 2.0, augment.BOX_ASPECT)}), 0) as int))) as bw,
  {u_sql(augment.BOX_Y)} as uy, {u_sql(augment.BOX_X)} as ux,
  {u_sql(augment.PASTE)} < 0.2 as p_on, {u_sql(augment.PASTE_H)} < 0.5 as ph, {u_sql(augment.PASTE_V)} < 0.5 as pv
from grid_sql g""")
cte("plan_px", """
select p.*, cast(floor(uy * (16 - bh + 1)) as int) as byy, cast(floor(ux * (16 - bw + 1)) as int) as bxx,
       cast(a.range as int) as dy, cast(b.range as int) as dx
from plan_sql p, range(16) a, range(16) b""")
cte("mosaic_px", """
select p.*, case when p.m_on and d.oy is not null then d.oy + p.dy else p.ty + p.dy end as my,
       case when p.m_on and d.ox is not null then d.ox + p.dx else p.tx + p.dx end as mx
from plan_px p left join donors_any d on d.image_id = p.image_id and d.ty = p.ty and d.tx = p.tx
 and d.slot = case when p.dy < p.sy and p.dx >= p.sx then 1 when p.dy >= p.sy and p.dx < p.sx then 2
                   when p.dy >= p.sy and p.dx >= p.sx then 3 end""")
CUT_TEST = "p.c_on and d.oy is not null and p.dy >= byy and p.dy < byy + bh and p.dx >= bxx and p.dx < bxx + bw"
cte("cut_px", f"""
select p.*, case when {CUT_TEST} then d.oy + p.dy else my end as qy,
       case when {CUT_TEST} then d.ox + p.dx else mx end as qx,
       case when {CUT_TEST} then d.oy + p.dy else p.ty + p.dy end as only_y,
       case when {CUT_TEST} then d.ox + p.dx else p.tx + p.dx end as only_x
from mosaic_px p left join donors_any d on d.image_id = p.image_id and d.ty = p.ty and d.tx = p.tx and d.slot = 4""")
cte("paste_at", """
select p.*, case when p.p_on then d.oy + case when pv then 15 - dy else dy end end as ry,
       case when p.p_on then d.ox + case when ph then 15 - dx else dx end end as rx
from cut_px p left join donors_target d on d.image_id = p.image_id and d.ty = p.ty and d.tx = p.tx""")


def _mix_sql(y: str, x: str) -> str:
    return f"""
select p.image_id, p.ty, p.tx, p.dy, p.dx, p.{y} as sy, p.{x} as sx, round(m.n0, 9) as n0, m.mask
from cut_px p join mask_px m on m.image_id = p.image_id and m.y = p.{y} and m.x = p.{x}"""


def _paste_sql(y: str, x: str) -> str:
    return f"""
select p.image_id, p.ty, p.tx, p.dy, p.dx,
       case when t.y is not null and m.mask <> 254 then p.ry else p.{y} end as sy,
       case when t.y is not null and m.mask <> 254 then p.rx else p.{x} end as sx,
       round(case when t.y is not null and m.mask <> 254 then t.n0 else m.n0 end, 9) as n0,
       case when t.y is not null and m.mask <> 254 then 0 else m.mask end as mask
from paste_at p join mask_px m on m.image_id = p.image_id and m.y = p.{y} and m.x = p.{x}
left join mask_px t on t.image_id = p.image_id and t.y = p.ry and t.x = p.rx and t.mask = 0"""


cte("own_px", "select *, ty + dy as oy0, tx + dx as ox0 from paste_at")


def _mixed_out(df):
    return df.select(
        "image_id", "ty", "tx", "dy", "dx", "sy", "sx", r(F.get("norm", 0)).alias("n0"), "mask"
    )


def _mixing(spark, sf):
    return augment.donors(
        _grid(spark, sf), view(spark, sf, "scenes"), PATCH, (1, 2, 3, 4), SEED, EPOCH
    )


@query("a5_mosaic", _mix_sql("my", "mx"))
def _(spark, sf):
    plan = augment.mosaic(_grid(spark, sf), _mixing(spark, sf), PATCH, SEED, EPOCH)
    return _mixed_out(augment.render(plan, _masked(spark, sf), PATCH))


@query("a6_cutmix", _mix_sql("only_y", "only_x"))
def _(spark, sf):
    plan = augment.cutmix(_grid(spark, sf), _mixing(spark, sf), PATCH, SEED, EPOCH)
    return _mixed_out(augment.render(plan, _masked(spark, sf), PATCH))


@query("a7_copy_paste", _paste_sql("oy0", "ox0").replace("from paste_at p", "from own_px p"))
def _(spark, sf):
    masked = _masked(spark, sf)
    integral = augment.label_integral(masked, view(spark, sf, "scenes"))
    found = augment.donors(
        _grid(spark, sf), view(spark, sf, "scenes"), PATCH, (augment.PASTE_SLOT,), SEED, EPOCH,
        F.col("target_px") > 0, integral,
    )
    plan = augment.copy_paste(_grid(spark, sf), found, SEED, EPOCH)
    return _mixed_out(augment.render(plan, masked, PATCH))


@query("a8_composed_patches", _paste_sql("qy", "qx"))
def _(spark, sf):
    return _mixed_out(augment.compose(
        _grid(spark, sf), _masked(spark, sf), view(spark, sf, "scenes"), PATCH, SEED, EPOCH
    ))


# ---- learning ----


@query("m1_pixel_classifier")
def _(spark, sf):
    """Fit on training scenes, predict every scene."""
    norm = normed(spark, sf)
    model = learn.fit_pixels(norm, truth(spark, sf), roles(spark, sf), view(spark, sf, "scenes"))
    return model.apply(norm).select(*PIXEL, "cls")


@query("m2_self_training")
def _(spark, sf):
    norm = normed(spark, sf)
    run = learn.self_train(
        norm, truth(spark, sf), roles(spark, sf), view(spark, sf, "scenes"), rounds=4,
        threshold=0.55, stable_iou=0.3, patience=2, iterations=20,
    )
    return run.model.apply(norm).select(*PIXEL, "cls")


# ---- monitoring ----

cte("gates", """
select run_id, min(epoch) + 1 as gate_epoch from (
  select *, count(*) over (partition by run_id, grp order by epoch) as streak from (
    select *, sum(case when iou >= 0.7 then 0 else 1 end) over (partition by run_id order by epoch) as grp
    from epoch_log) where iou >= 0.7)
where streak >= 3 group by run_id""")


@query("g1_stability_gate", """
select e.run_id, max(e.epochs) as epochs, max(g.gate_epoch) as gate_epoch
from epoch_log e left join gates g using (run_id) group by e.run_id""")
def _(spark, sf):
    return monitor.gate(view(spark, sf, "epoch_log"))


@query("g2_ramp", """
select e.run_id, e.epoch, case when g.gate_epoch is null or e.epoch < g.gate_epoch then 0.0
  else least(1.0, (e.epoch - g.gate_epoch + 1)
       / greatest(5, round(cast(0.6 as double) * (e.epochs - (g.gate_epoch - 1))))) end as ramp
from epoch_log e left join gates g using (run_id)""")
def _(spark, sf):
    return monitor.ramp(view(spark, sf, "epoch_log")).select("run_id", "epoch", "ramp")


@query("g3_epoch_summary", """
select run_id, epoch, count(*) as batches, round(sum(loss_sup) / count(*), 9) as loss_sup,
       case when sum(uni) <> 0 then sum(inter) / sum(uni) end as iou
from batch_log group by run_id, epoch""")
def _(spark, sf):
    return monitor.epoch_summary(view(spark, sf, "batch_log")).withColumn("loss_sup", r("loss_sup"))


# ---- catalog upkeep ----


@query("s5_label_sink", "select image_id, y, x, case when image_id = 1 then 1 else label end as label from fixed_masks")
def _(spark, sf):
    """Write all masks, overwrite one scene's, read back."""
    path = scratch(spark)
    masks = truth(spark, sf)
    tables.write_labels(masks, path, "user")
    tables.write_labels(masks.withColumn("label", F.lit(0)), path, "model")
    tables.write_labels(masks.filter("image_id = 1").withColumn("label", F.lit(1)), path, "user")
    return tables.read_labels(spark, path, "user")


@query("s8_cascade_delete", """
select name, 'scene' as kept_in, role from eff_split where name not in (select name from scenes where image_id % 3 = 1)
union all
select name, 'override', role from overrides where name not in (select name from scenes where image_id % 3 = 1)
union all
select name, 'score', role from scored where image_id % 3 <> 1""")
def _(spark, sf):
    gone = view(spark, sf, "scenes").filter("image_id % 3 = 1")
    kept = tables.delete_images(
        gone, scene=roles(spark, sf), override=view(spark, sf, "overrides"), score=scored(spark, sf)
    )
    out = None
    for name, rows in kept.items():
        part = rows.select("name", F.lit(name).alias("kept_in"), "role")
        out = part if out is None else out.unionByName(part)
    return out


def _versions(spark, sf):
    latest = view(spark, sf, "edits").groupBy("image_id").agg(F.max("seq").alias("label_version"))
    return view(spark, sf, "scenes").select("image_id").join(latest, "image_id", "left").select(
        "image_id", F.lit(2).alias("model_version"),
        F.coalesce("label_version", F.lit(-1).cast("bigint")).alias("label_version"),
    )


@query("s9_score_cache", """
with v as (select s.image_id, 2 as model_version, coalesce(max(e.seq), -1) as label_version
           from scenes s left join edits e using (image_id) group by s.image_id)
select image_id, image_id % 4 < 2 as cached from v""")
def _(spark, sf):
    """Scenes 0, 1 mod 4 are cached at this version; 2 mod 4 at an old label version."""
    now = _versions(spark, sf)
    cache = now.filter("image_id % 4 < 3").withColumn(
        "label_version",
        F.when(F.col("image_id") % 4 == 2, F.col("label_version") - 1).otherwise(F.col("label_version")),
    ).withColumn("iou", F.lit(0.5))
    todo = tables.scores_to_compute(now, cache).select("image_id", F.lit(False).alias("cached"))
    kept = tables.cached_scores(now, cache).select("image_id", F.lit(True).alias("cached"))
    return todo.unionByName(kept)


# The default palette.
PALETTE = [(0, "Target", "#ff5028"), (1, "Background", "#3c8cff")]


@query("p9_class_overlay", """
select image_id, y, x, case cls when 0 then 255 when 1 then 60 else 0 end as red,
       case cls when 0 then 80 when 1 then 140 else 0 end as green,
       case cls when 0 then 40 when 1 then 255 else 0 end as blue,
       case when cls in (0, 1) then 160 else 0 end as alpha
from ppx""")
def _(spark, sf):
    from pixelframe.operators.overlay import colorize

    classes = spark.createDataFrame(PALETTE, "id int, name string, color string")
    return colorize(predicted(spark, sf), classes).select(
        *PIXEL, "red", "green", "blue", "alpha"
    )


# ---- streams: the event table arrives as a file stream, results equal the batch forms ----

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _event_stream(spark, sf, fixture):
    """A fixture view over the event table read as a stream."""
    from .fixtures import VIEWS

    name = f"events_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf)
    stream.createOrReplaceTempView(name)
    out = spark.sql(VIEWS[fixture].replace("{events}", name))
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


@query("r1_stream_labels", "select image_id, y, x, label, seq from replayed")
def _(spark, sf):
    base = scratch(spark)
    run = edit_stream.stream_labels(
        _event_stream(spark, sf, "edits"), view(spark, sf, "scenes"), f"{base}/state", f"{base}/log"
    )
    run.awaitTermination()
    return label_state.read_state(spark, f"{base}/state")


@query("e11_live_iou_stream", """
select image_id, count(*) filter (where label = 0 and cls = 0 and valid) as tp,
       count(*) filter (where label not in (0, 255) and cls = 0 and valid) as fp,
       count(*) filter (where label = 0 and cls <> 0 and valid) as fn,
       count(*) filter (where label not in (0, 255) and cls <> 0 and valid) as tn,
       case when count(*) filter (where label = 0 and valid) > 0 then
         count(*) filter (where label = 0 and cls = 0 and valid)
         / count(*) filter (where label <> 255 and valid and (label = 0 or cls = 0)) end as iou
from replayed join ppx using (image_id, y, x) group by image_id having count(*) filter (where valid) > 0""")
def _(spark, sf):
    """Edits arrive in four files out of order; counts follow by retraction."""
    base, edits = scratch(spark), view(spark, sf, "edits")
    late = F.pmod(F.hash("seq"), F.lit(4))
    edits.withColumn("part", late).repartition(4, "part").drop("part").write.parquet(f"{base}/in")
    flow = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    run = edit_stream.stream_labels(
        flow, view(spark, sf, "scenes"), f"{base}/state", f"{base}/log", pred=predicted(spark, sf)
    )
    run.awaitTermination()
    return label_state.read_live(spark, f"{base}/state")


@query("r2_save_points", """
with g as (select image_id, ts, case when ts - lag(ts) over w <= interval 10 minutes then 0 else 1 end as fresh
           from edits window w as (partition by image_id order by ts)),
b as (select *, sum(fresh) over (partition by image_id order by ts rows unbounded preceding) as burst from g)
select image_id, max(ts) + interval 10 minutes as saved_at, count(*) as edits from b group by image_id, burst""")
def _(spark, sf):
    edits = view(spark, sf, "edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.save_points(edits, "10 minutes")


@query("r3_stream_gate", "select run_id, gate_epoch from gates")
def _(spark, sf):
    """The epoch log arrives in three parts; each is read as a micro-batch of a stream taken up again."""
    base = scratch(spark)
    log = view(spark, sf, "epoch_log").withColumn("part", F.ntile(3).over(_by_epoch()))
    log.write.partitionBy("part").parquet(f"{base}/parts")
    shape = "run_id bigint, epoch int, epochs int, iou double"
    for part in (1, 2, 3):
        spark.read.schema(shape).parquet(f"{base}/parts/part={part}").write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(shape).parquet(f"{base}/log")
        run = (
            gate_stream.stream_gate(stream).writeStream.outputMode("append").format("parquet")
            .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.schema("run_id bigint, gate_epoch int").parquet(f"{base}/out")


def _by_epoch():
    from pyspark.sql import Window

    return Window.partitionBy("run_id").orderBy("epoch")


@query("r4_label_rate", """
select image_id, time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as "end",
       count(*) as edits from edits group by all""")
def _(spark, sf):
    edits = view(spark, sf, "edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.label_rate(edits, "1 hour")


@query("r4_label_rate_sliding", """
with w as (select image_id, time_bucket(interval 30 minutes, ts) - k * interval 30 minutes as start
           from edits, (values (0), (1)) s(k))
select image_id, start, start + interval 1 hour as "end", count(*) as edits from w group by all""")
def _(spark, sf):
    edits = view(spark, sf, "edits").withColumn("ts", F.col("ts").cast("timestamp"))
    return monitor.label_rate(edits, "1 hour", "30 minutes")
