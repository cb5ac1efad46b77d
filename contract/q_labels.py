"""Label repair, edits, replay and merging."""

from pyspark.sql import functions as F

from pixelframe.operators import labels

from .common import normed, predicted, r, truth
from .fixtures import view
from .registry import cte, query

cte("stamped", """
select e.seq, e.image_id, e.value, cast(y.range as int) as y, cast(x.range as int) as x
from edits e join scenes s using (image_id), range(30) y, range(50) x
where e.kind = 'stamp' and (x.range - e.cx) ** 2 + (y.range - e.cy) ** 2 <= e.r * e.r""")
cte("clear_rows", "select image_id, seq from edits where kind = 'clear'")
cte("replayed", """
select image_id, y, x, value as label, seq from (
  select *, row_number() over (partition by image_id, y, x order by seq desc) as rk from stamped) t
where rk = 1 and value <> 255
  and seq > coalesce((select max(c.seq) from clear_rows c where c.image_id = t.image_id), -1)""")
cte("all_writes", """
select image_id, y, x, seq, value from stamped
union all
select c.image_id, p.y, p.x, c.seq, 255 from clear_rows c
join (select distinct image_id, y, x from stamped) p using (image_id)""")
cte("diffs", """
select * from (
  select image_id, y, x, seq, value, lag(value, 1, 255) over (partition by image_id, y, x order by seq) as prev
  from all_writes)
where value <> prev""")


@query("l1_repair_mask", "select image_id, y, x, label from fixed_masks")
def _(spark, sf):
    return truth(spark, sf)


@query("l2_collapse_labels", """
select image_id, y, x, case when not valid then 254 else label end as mask,
       case when not valid or label = 255 then 255 when label <> 0 then 1 else 0 end as target
from judged""")
def _(spark, sf):
    from .common import judged

    return labels.collapse_labels(judged(spark, sf)).select("image_id", "y", "x", "mask", "target")


@query("l3_label_counts", """
select image_id, count(*) filter (where label <> 255) as labeled_px from fixed_masks group by image_id""")
def _(spark, sf):
    return labels.label_counts(truth(spark, sf))


@query("l4_brush_stamp", "select seq, image_id, value, y, x from stamped")
def _(spark, sf):
    edits = view(spark, sf, "edits").filter("kind = 'stamp'")
    return labels.stamp(edits, view(spark, sf, "scenes")).select(
        "seq", "image_id", "value", "y", "x"
    )


@query("l5_stroke_points", """
with moved as (select *, coalesce(lag(cx) over w, cx) as px, coalesce(lag(cy) over w, cy) as py
               from strokes window w as (partition by stroke_id order by pos)),
counted as (select *, greatest(1, cast(ceil(sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / (r / 2)) as int)) as steps
            from moved)
select stroke_id, image_id, pos, cast(i.range as int) as step,
       round(px + (cx - px) * i.range / steps, 9) as sx, round(py + (cy - py) * i.range / steps, 9) as sy
from counted, range(1, 400) i where i.range <= steps""")
def _(spark, sf):
    return labels.stroke_points(view(spark, sf, "strokes")).select(
        "stroke_id", "image_id", "pos", "step", r("sx").alias("sx"), r("sy").alias("sy")
    )


@query("l6_polygon_fill", """
with e as (select image_id, poly_id, vx as ax, vy as ay,
             coalesce(lead(vx) over w, first_value(vx) over w) as bx,
             coalesce(lead(vy) over w, first_value(vy) over w) as by_,
             count(*) over (partition by poly_id) as n
           from polygons window w as (partition by poly_id order by vertex)),
hit as (select e.image_id, e.poly_id, y.range as y,
          ax + ((y.range + 0.5 - ay) / (by_ - ay)) * (bx - ax) as c
        from e join scenes s using (image_id), range(30) y
        where n >= 3 and (ay <= y.range + 0.5) <> (by_ <= y.range + 0.5))
select image_id, poly_id, cast(y as int) as y, cast(x.range as int) as x
from hit, range(50) x
group by image_id, poly_id, y, x.range
having count(*) filter (where floor(c + 0.5) <= x.range) % 2 = 1""")
def _(spark, sf):
    """Even-odd fill; the check counts crossings left of each pixel instead of pairing them."""
    return labels.fill_polygons(view(spark, sf, "polygons"), view(spark, sf, "scenes"))


def _replayed(spark, sf):
    edits = view(spark, sf, "edits")
    return labels.replay(
        labels.pixel_edits(edits, view(spark, sf, "scenes")), edits.filter("kind = 'clear'")
    )


@query("l7_replay", "select image_id, y, x, label, seq from replayed")
def _(spark, sf):
    return _replayed(spark, sf)


@query("l8_edit_diff", "select image_id, y, x, seq, prev, value from diffs")
def _(spark, sf):
    return labels.edit_diff(view(spark, sf, "edits"), view(spark, sf, "scenes"))


# Every fifth event is an undo. The SQL walks each scene's log edit by edit, with the pixels of a scene
# as a list of seq * 256 + label and the stack as the lists before each edit.
@query("l9_undo", """
with undo_moves as (
  select e.image_id, row_number() over (partition by e.image_id order by seq) as n, seq,
         case when seq % 5 = 3 then 'undo' else kind end as kind, value, cx, cy, r
  from edits e join scenes s on e.image_id = s.image_id),
undo_walk(image_id, n, state, stack) using key (image_id) as (
  select image_id, cast(0 as bigint), list_transform(range(1500), lambda i: cast(255 as bigint)), cast([] as varchar[])
  from scenes
  union
  select image_id, m, case when kind = 'undo' then coalesce(cast(string_split(stack[-1], ',') as bigint[]), state) when changed then cand else state end,
         case when kind = 'undo' then stack[:-2] when changed then list_append(stack, array_to_string(state, ','))[-50:] else stack end
  from (
    select *, kind <> 'undo' and list_transform(cand, lambda c: c % 256) <> list_transform(state, lambda c: c % 256) as changed
    from (
      select w.image_id, w.state, w.stack, m.n as m, m.kind,
             case m.kind when 'stamp' then list_transform(range(1500), lambda i:
                    case when (i % 50 - cx) * (i % 50 - cx) + (i // 50 - cy) * (i // 50 - cy) <= r * r
                         then seq * 256 + value else state[i + 1] end)
                  when 'clear' then list_transform(range(1500), lambda i: cast(255 as bigint)) end as cand
      from undo_walk w join undo_moves m on m.image_id = w.image_id and m.n = w.n + 1) a) b),
undo_cells as (select image_id, unnest(range(1500)) as i, unnest(state) as c from undo_walk)
select image_id, cast(i // 50 as int) as y, cast(i % 50 as int) as x, cast(c % 256 as int) as label, c // 256 as seq
from undo_cells where c % 256 <> 255""", recursive=True)
def _(spark, sf):
    from pixelframe.operators.undo import replay_with_undo

    edits = view(spark, sf, "edits")
    kind = F.when(F.col("seq") % 5 == 3, "undo").otherwise(F.col("kind"))
    return replay_with_undo(edits.withColumn("kind", kind), view(spark, sf, "scenes"))


@query("l10_clear", """
select d.image_id, d.seq, count(*) as cleared_px from diffs d join clear_rows c using (image_id, seq)
group by d.image_id, d.seq""")
def _(spark, sf):
    """Pixels each clear really wiped."""
    wiped = labels.wiped_pixels(view(spark, sf, "edits"), view(spark, sf, "scenes"))
    return wiped.groupBy("image_id", "seq").agg(F.count(F.lit(1)).alias("cleared_px"))


@query("l11_adopt_prediction", """
select image_id, y, x, case when label = 255 then cls else label end as label,
       label = 255 and cls <> 255 as filled
from judged""")
def _(spark, sf):
    return labels.adopt(truth(spark, sf), predicted(spark, sf))


@query("l12_export_merge", """
select image_id, y, x, case when not valid then 255 when label <> 255 then label else cls end as mask
from judged""")
def _(spark, sf):
    drawn = truth(spark, sf).filter("label <> 255")
    return labels.merge_export(predicted(spark, sf), drawn)


@query("l13_selection_commit", """
with chosen as (select image_id, y, x from npx where n0 > 0.8)
select image_id, y, x, 1 as label, cast(1000000000 as bigint) as seq from chosen
union all
select image_id, y, x, label, seq from replayed r
where not exists (select 1 from chosen c where c.image_id = r.image_id and c.y = r.y and c.x = r.x)""")
def _(spark, sf):
    edits = view(spark, sf, "edits")
    chosen = normed(spark, sf).filter(F.get("norm", 0) > 0.8)
    commit = labels.commit_selection(chosen, 1_000_000_000, 1)
    writes = labels.pixel_edits(edits, view(spark, sf, "scenes")).unionByName(commit)
    return labels.replay(writes, edits.filter("kind = 'clear'"))
