"""Shared Spark pipelines and oracle CTEs of the fixture scenes."""

from pyspark.sql import functions as F

from pixelframe.operators import evaluate, labels, normalize, scoring, split

from .fixtures import fixture_logits, pixels, view
from .registry import cte

PATCH, STRIDE = 16, 8
RATIO = 0.3


def valid_px(spark, sf):
    return normalize.with_valid(pixels(spark, sf))


def normed(spark, sf):
    px = valid_px(spark, sf)
    return normalize.normalize(px, normalize.band_stats(px))


def predicted(spark, sf):
    return scoring.predict_pixelwise(normed(spark, sf), fixture_logits())


def truth(spark, sf):
    return labels.repair_mask(view(spark, sf, "raw_masks")).drop("raw_label")


def judged(spark, sf):
    """Repaired labels beside the prediction, per pixel."""
    pred = predicted(spark, sf).select("image_id", "y", "x", "valid", "probs", "cls")
    return evaluate.match_labels(truth(spark, sf), pred)


def roles(spark, sf):
    return split.effective_split(
        view(spark, sf, "scenes"), view(spark, sf, "overrides"), RATIO, "md5"
    )


def scored(spark, sf):
    return evaluate.score_images(judged(spark, sf), view(spark, sf, "scenes"), roles(spark, sf))


def r(column, digits=9):
    """Round away float summation noise, on both sides of the comparison alike."""
    return F.round(column, digits)


cte("vpx", "select *, b0 <> -9999 and b1 <> -9999 and b2 <> -9999 and b3 <> -9999 as valid from px")
cte("lpx", """
select image_id, y, x, valid, 0 as band, b0 as v from vpx union all
select image_id, y, x, valid, 1, b1 from vpx union all
select image_id, y, x, valid, 2, b2 from vpx union all
select image_id, y, x, valid, 3, b3 from vpx""")
cte("rawstat", """
select image_id, band, coalesce(quantile_cont(v, 0.02) filter (where valid), 0.0) as lo,
       coalesce(quantile_cont(v, 0.98) filter (where valid), 1.0) as hi0
from lpx group by image_id, band""")
cte("bandstat", "select image_id, band, lo, case when hi0 <= lo then lo + 1 else hi0 end as hi from rawstat")
cte("lnorm", """
select l.image_id, l.y, l.x, l.valid, l.band,
       case when l.valid then least(greatest((l.v - s.lo) / (s.hi - s.lo), 0.0), 1.0) else 0.0 end as n
from lpx l join bandstat s on l.image_id = s.image_id and l.band = s.band""")
cte("npx", """
select image_id, y, x, valid,
       max(n) filter (where band = 0) as n0, max(n) filter (where band = 1) as n1,
       max(n) filter (where band = 2) as n2, max(n) filter (where band = 3) as n3
from lnorm group by image_id, y, x, valid""")
cte("zpx", "select *, 2 * n0 - n1 + 0.5 * n2 as z0, 0.3 + 0.2 * n3 as z1 from npx")
cte("ppx", """
select *, exp(z0 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) as p0,
       exp(z1 - greatest(z0, z1)) / (exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1))) as p1,
       case when not valid then 255 when z0 >= z1 then 0 else 1 end as cls
from zpx""")
cte("fixed_masks", """
select image_id, y, x,
       case when raw_label is null or isnan(raw_label) or raw_label < 0 or raw_label > 255
                 or raw_label = 254 then 255 else cast(trunc(raw_label) as int) end as label
from raw_masks""")
cte("judged", """
select p.*, m.label from ppx p join fixed_masks m
on p.image_id = m.image_id and p.y = m.y and p.x = m.x""")
cte("conf", """
select image_id,
       count(*) filter (where label <> 255 and valid and label = 0 and cls = 0) as tp,
       count(*) filter (where label <> 255 and valid and label <> 0 and cls = 0) as fp,
       count(*) filter (where label <> 255 and valid and label = 0 and cls <> 0) as fn,
       count(*) filter (where label <> 255 and valid and label <> 0 and cls <> 0) as tn
from judged group by image_id""")
cte("base_split", """
select name, row_number() over (order by md5(name), name)
             <= floor(cast(0.3 as double) * count(*) over ()) as base_val
from scenes""")
cte("eff_split", """
select b.name, coalesce(o.role, case when b.base_val then 'validation' else 'training' end) as role
from base_split b left join overrides o on o.name = b.name""")
cte("scored", """
select c.image_id, s.name, e.role, c.tp, c.fp, c.fn, c.tn,
       case when tp + fp + fn > 0 then tp / (tp + fp + fn) end as iou,
       case when tp + fp > 0 then tp / (tp + fp) end as precision,
       case when tp + fn > 0 then tp / (tp + fn) end as recall,
       case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end as f1,
       case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) end as accuracy,
       case when tp + fp + fn + tn = 0 then 'unlabeled' when tp + fn = 0 then 'background only'
            else 'scored' end as status
from conf c join scenes s on s.image_id = c.image_id join eff_split e on e.name = s.name""")
