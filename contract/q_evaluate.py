"""Split, accuracy and losses."""

from pyspark.sql import functions as F

from pixelframe.functions.arrays import softmax
from pixelframe.operators import evaluate, labels, split

from .common import RATIO, judged, predicted, r, roles, scored, truth
from .fixtures import fixture_logits, view
from .registry import cte, query

cte("doc_conf", """
select image_id,
       count(*) filter (where label <> 255 and valid and label = 0 and cls = 0) as tp,
       count(*) filter (where label <> 255 and valid and label <> 0 and cls = 0) as fp,
       count(*) filter (where label <> 255 and valid and label = 0 and cls <> 0) as fn,
       count(*) filter (where label <> 255 and valid and label <> 0 and cls <> 0) as tn
from eval_docs group by image_id""")
METRIC_SQL = """
  case when tp + fp + fn > 0 then tp / (tp + fp + fn) end as {p}iou,
  case when tp + fp > 0 then tp / (tp + fp) end as {p}precision,
  case when tp + fn > 0 then tp / (tp + fn) end as {p}recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end as {p}f1,
  case when tp + fp + fn + tn > 0 then (tp + tn) / (tp + fp + fn + tn) end as {p}accuracy"""
POOL_SQL = """
  count(role) as images, count(*) filter (where status <> 'unlabeled') as scored_images,
  count(iou) filter (where status <> 'unlabeled') as macro_images,
  cast(coalesce(sum(tp), 0) as bigint) as tp, cast(coalesce(sum(fp), 0) as bigint) as fp,
  cast(coalesce(sum(fn), 0) as bigint) as fn, cast(coalesce(sum(tn), 0) as bigint) as tn,
  round(avg(iou), 9) as macro_iou, round(avg(precision), 9) as macro_precision,
  round(avg(recall), 9) as macro_recall, round(avg(f1), 9) as macro_f1,
  round(avg(accuracy), 9) as macro_accuracy"""
cte("pooled", f"""
select k.role as role, {POOL_SQL.replace("count(role)", "count(s.role)")}
from (values ('training'), ('validation')) k(role) left join scored s on s.role = k.role
group by k.role""")


@query("d1_split_rank", "select name, md5(name) as rank from scenes")
def _(spark, sf):
    return view(spark, sf, "scenes").select("name", split.split_rank("name", "md5").alias("rank"))


@query("d1_split_rank_blake2b")
def _(spark, sf):
    return view(spark, sf, "scenes").select(
        "name", split.split_rank("name", "blake2b").alias("rank")
    )


# Customers act as scene names of many projects (one per nation).
@query("d2_base_split", """
select c_nationkey, c_name as name from (
  select c_nationkey, c_name, row_number() over (partition by c_nationkey order by md5(c_name), c_name) as rk,
         count(*) over (partition by c_nationkey) as n from customer)
where rk <= floor(cast(0.29 as double) * n)""")
def _(spark, sf):
    from .fixtures import table

    names = table(spark, sf, "customer").select("c_nationkey", F.col("c_name").alias("name"))
    return split.base_validation(names, 0.29, "md5", "c_nationkey").select("c_nationkey", "name")


@query("d3_effective_split", "select name, role from eff_split")
def _(spark, sf):
    return roles(spark, sf)


@query("d4_minimal_override", """
with wanted as (select name, case when image_id % 3 = 0 then 'validation' else 'training' end as role
                from scenes where image_id % 3 <> 2)
select o.name, o.role from overrides o where o.name not in (select name from wanted)
union all
select w.name, w.role from wanted w join base_split b using (name)
where (w.role = 'validation') <> b.base_val""")
def _(spark, sf):
    scenes = view(spark, sf, "scenes")
    wanted = scenes.filter("image_id % 3 <> 2").select(
        "name", F.when(F.col("image_id") % 3 == 0, "validation").otherwise("training").alias("role")
    ).unionByName(scenes.select(F.lit("nope.tif").alias("name"), F.lit("training").alias("role"))
                  .distinct())
    return split.set_role(scenes, view(spark, sf, "overrides"), wanted, RATIO, "md5")


@query("e1_confusion", "select image_id, tp, fp, fn, tn from conf")
def _(spark, sf):
    return evaluate.confusion(judged(spark, sf))


@query("e1_confusion_documents", "select image_id, tp, fp, fn, tn from doc_conf")
def _(spark, sf):
    return evaluate.confusion(view(spark, sf, "eval_docs"))


@query("e2_metrics", f"select image_id, {METRIC_SQL.format(p='')} from conf")
def _(spark, sf):
    return evaluate.derive(evaluate.confusion(judged(spark, sf))).select(
        "image_id", *evaluate.METRICS
    )


@query("e3_status", """
with c as (select doc_id, label, cls, valid from eval_docs)
select doc_id, case when label = 255 or not valid then 'unlabeled' when label <> 0 then 'background only'
            else 'scored' end as status from c""")
def _(spark, sf):
    """Status of every document as a set of its own: all three outcomes occur."""
    counts = evaluate.confusion(view(spark, sf, "eval_docs"), ["doc_id"])
    return counts.select("doc_id", evaluate.status().alias("status"))


@query("e4_image_scores", """
select image_id, name, role, status, tp, fp, fn, tn, iou, precision, recall, f1, accuracy,
       tp + fp + fn + tn as labeled_px, tp + fn as gt_target_px, tp + fp as pred_target_px
from scored""")
def _(spark, sf):
    return scored(spark, sf)


def _rounded(df):
    return df.withColumns({
        f"macro_{m}": r(f"macro_{m}") for m in evaluate.METRICS
    })


@query("e5_e6_aggregate", f"""
select role, {POOL_SQL}, {METRIC_SQL.format(p='micro_').replace('tp', 'sum(tp)').replace('fp', 'sum(fp)').replace('fn', 'sum(fn)').replace('tn', 'sum(tn)')},
       sum(tp) + sum(fp) + sum(fn) > 0 as scoreable
from scored group by role""")
def _(spark, sf):
    return _rounded(evaluate.aggregate(scored(spark, sf)))


@query("e7_scoreable", """
select role, sum(tp) + sum(fp) + sum(fn) > 0 as scoreable from scored group by role""")
def _(spark, sf):
    return evaluate.aggregate(scored(spark, sf)).select("role", "scoreable")


@query("e8_report", f"""
select *, {METRIC_SQL.format(p='micro_')}, tp + fp + fn > 0 as scoreable from (
  select * from pooled union all select cast(null as varchar) as role, {POOL_SQL} from scored)""")
def _(spark, sf):
    return _rounded(evaluate.report(scored(spark, sf), total=True))


@query("e8_report_one_set_empty", f"""
with only_training as (select * from scored where role = 'training'),
both_sets as (select k.role as role, {POOL_SQL.replace("count(role)", "count(s.role)")}
  from (values ('training'), ('validation')) k(role) left join only_training s on s.role = k.role
  group by k.role)
select *, {METRIC_SQL.format(p='micro_')}, tp + fp + fn > 0 as scoreable from both_sets""")
def _(spark, sf):
    return _rounded(evaluate.report(scored(spark, sf).filter("role = 'training'")))


@query("e9_generalisation_gap", f"""
with m as (select role, {METRIC_SQL.format(p='')} from pooled)
select round((select iou from m where role = 'training') - (select iou from m where role = 'validation'), 9) as gap,
       coalesce((select iou from m where role = 'training') - (select iou from m where role = 'validation') > 0.15, false) as flagged""")
def _(spark, sf):
    return evaluate.gap(evaluate.report(scored(spark, sf))).select(r("gap").alias("gap"), "flagged")


@query("e10_sorted_report", "select name, iou from scored order by iou desc nulls last, name")
def _(spark, sf):
    return evaluate.sort_report(scored(spark, sf), "iou", ascending=False).select("name", "iou")


@query("e11_live_target_iou", """
select image_id, lang,
       case when count(*) filter (where label = 0 and valid) > 0 then
         count(*) filter (where label = 0 and cls = 0 and valid)
         / count(*) filter (where label <> 255 and valid and (label = 0 or cls = 0)) end as iou
from (select e.*, d.lang from eval_docs e join documents d using (doc_id)) t
group by image_id, lang""")
def _(spark, sf):
    from .fixtures import table

    docs = view(spark, sf, "eval_docs").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return evaluate.target_iou(docs, ["image_id", "lang"])


@query("e12_repool", f"""
select role, {POOL_SQL}, {METRIC_SQL.format(p='micro_').replace('tp', 'sum(tp)').replace('fp', 'sum(fp)').replace('fn', 'sum(fn)').replace('tn', 'sum(tn)')},
       sum(tp) + sum(fp) + sum(fn) > 0 as scoreable
from scored where image_id % 4 <> 0 group by role""")
def _(spark, sf):
    removed = view(spark, sf, "scenes").filter("image_id % 4 = 0")
    return _rounded(evaluate.repool(scored(spark, sf), removed))


@query("e13_mask_agreement", """
select image_id, count(*) filter (where label = 0 and cls = 0) as inter,
       count(*) filter (where label = 0 or cls = 0) as uni,
       count(*) filter (where label = 0 and cls = 0) / count(*) filter (where label = 0 or cls = 0) as iou,
       count(*) filter (where label = 0 and cls = 0) / count(*) filter (where label = 0 or cls = 0) > 0.99 as agrees
from judged group by image_id having count(*) filter (where label = 0 or cls = 0) > 0""")
def _(spark, sf):
    a = truth(spark, sf).filter("label = 0")
    b = predicted(spark, sf).filter("cls = 0")
    return evaluate.mask_iou(a, b)


def _losses(spark, sf):
    """Collapsed labels with two views: the fixture prediction and one at half temperature."""
    halved = F.transform(fixture_logits(), lambda z: z * 0.5)
    base = judged(spark, sf)
    rows = labels.collapse_labels(base).withColumn("label", F.col("target"))
    views = predicted(spark, sf).select(
        "image_id", "y", "x", softmax(halved).alias("weak_probs")
    )
    return rows.join(views, ["image_id", "y", "x"]).withColumn("strong_probs", F.col("probs"))


cte("loss_rows", """
select image_id, y, x, case when not valid or label = 255 then 255 when label <> 0 then 1 else 0 end as t,
       valid and label = 255 as free,
       p0, p1, 1 / (1 + exp((z1 - z0) / 2)) as q0, 1 / (1 + exp((z0 - z1) / 2)) as q1
from judged""")
cte("ce_sql", """
select image_id, coalesce(sum(case t when 0 then -2 * ln(p0) when 1 then -ln(p1) end), 0)
         / greatest(coalesce(sum(case t when 0 then 2 when 1 then 1 end), 0), 1e-6) as ce
from loss_rows group by image_id""")
cte("dice_sql", """
select image_id,
  (case when count(*) filter (where t = 0) > 0 then
     1 - 2 * sum(p0) filter (where t = 0) / (sum(p0) filter (where t < 2) + count(*) filter (where t = 0)) else 0 end
   + case when count(*) filter (where t = 1) > 0 then
     1 - 2 * sum(p1) filter (where t = 1) / (sum(p1) filter (where t < 2) + count(*) filter (where t = 1)) else 0 end) / 2 as dice
from loss_rows group by image_id""")
cte("lovasz_sql", """
select image_id, avg(loss) as lovasz from (
  select image_id, c, sum(err * (j - prev_j)) as loss from (
    select *, coalesce(lag(j) over (partition by image_id, c order by rk), 0.0) as prev_j from (
      select *, 1 - (g - hits) / (g + rk - hits) as j from (
        select image_id, c, err, fg, row_number() over o as rk, sum(fg) over o as hits,
               sum(fg) over (partition by image_id, c) as g
        from (select image_id, y, x, 0 as c, case t when 0 then 1 else 0 end as fg,
                     abs(case t when 0 then 1 else 0 end - p0) as err from loss_rows where t < 2
              union all
              select image_id, y, x, 1, case t when 1 then 1 else 0 end,
                     abs(case t when 1 then 1 else 0 end - p1) from loss_rows where t < 2)
        window o as (partition by image_id, c order by err desc, y, x
                     rows between unbounded preceding and current row)) a
      where g > 0) b) d
  group by image_id, c) e
group by image_id""")
cte("pseudo_sql", """
select image_id, coalesce(sum(case when q0 >= q1 then -ln(p0) else -ln(p1) end)
                          filter (where free and greatest(q0, q1) > 0.6), 0)
       / greatest(count(*) filter (where free and greatest(q0, q1) > 0.6), 1) as pseudo
from loss_rows group by image_id""")
cte("cons_sql", """
select image_id, coalesce(avg(((p0 - q0) ** 2 + (p1 - q1) ** 2) / 2) filter (where free), 0) as cons
from loss_rows group by image_id""")


@query("e14_cross_entropy", "select image_id, round(ce, 9) as ce from ce_sql")
def _(spark, sf):
    return evaluate.ce(_losses(spark, sf)).select("image_id", r("ce").alias("ce"))


@query("e14_cross_entropy_unweighted", """
select image_id, round(coalesce(sum(case t when 0 then -ln(p0) when 1 then -ln(p1) end), 0)
                       / greatest(count(*) filter (where t < 2), 1), 9) as ce
from loss_rows group by image_id""")
def _(spark, sf):
    return evaluate.ce(_losses(spark, sf), weights=None).select("image_id", r("ce").alias("ce"))


@query("e15_dice", "select image_id, round(dice, 9) as dice from dice_sql")
def _(spark, sf):
    return evaluate.dice(_losses(spark, sf)).select("image_id", r("dice").alias("dice"))


@query("e16_lovasz", "select image_id, round(lovasz, 9) as lovasz from lovasz_sql")
def _(spark, sf):
    return evaluate.lovasz(_losses(spark, sf)).select("image_id", r("lovasz").alias("lovasz"))


@query("e17_pseudo_labels", """
select image_id, y, x, case when p0 >= p1 then 0 else 1 end as pseudo
from judged where valid and label = 255 and greatest(p0, p1) > 0.75""")
def _(spark, sf):
    return evaluate.pseudo_labels(labels.collapse_labels(judged(spark, sf)), 0.75).select("image_id", "y", "x", "pseudo")


@query("e18_consistency", "select image_id, round(cons, 9) as cons from cons_sql")
def _(spark, sf):
    return evaluate.consistency(_losses(spark, sf)).select("image_id", r("cons").alias("cons"))


@query("e19_total_loss", """
select c.image_id, round(ce + 0.5 * dice + lovasz + 0.4 * (0.5 * pseudo + cons), 9) as total
from ce_sql c join dice_sql using (image_id) join lovasz_sql using (image_id)
     join pseudo_sql using (image_id) join cons_sql using (image_id)""")
def _(spark, sf):
    rows = _losses(spark, sf)
    return evaluate.total_loss(rows, 0.4, threshold=0.6).select("image_id", r("total").alias("total"))
