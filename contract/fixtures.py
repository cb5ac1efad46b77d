"""Fixture views over the given tables, as portable SQL that Spark and DuckDB both run.

`{table}` stands for a given table: a Parquet path in Spark, the registered view in DuckDB.
"""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "px": """
select cast(floor(o_orderkey / 1500) as int) as image_id,
       cast(floor((o_orderkey % 1500) / 50) as int) as y,
       cast(o_orderkey % 50 as int) as x,
       case when o_orderkey % 17 = 0 then cast(-9999 as double) else o_totalprice end as b0,
       cast(o_custkey as double) as b1,
       cast(dayofyear(o_orderdate) as double) as b2,
       cast(substr(o_orderpriority, 1, 1) as double) as b3
from {orders}""",
    "scenes": """
select image_id,
       concat('img_', lpad(cast(image_id as string), 4, '0'), '.tif') as name,
       30 as height, 50 as width,
       case when image_id % 5 = 4 then null when image_id % 7 = 6 then 3 else 4 end as band_count,
       cast(-9999 as double) as nodata,
       cast(10 as double) as ta, cast(0 as double) as tb,
       cast(500000 + image_id * 500 as double) as tc,
       cast(0 as double) as td, cast(-10 as double) as te, cast(5200000 as double) as tf
from (select distinct cast(floor(o_orderkey / 1500) as int) as image_id from {orders}) s""",
    "raw_masks": """
select cast(floor(o_orderkey / 1500) as int) as image_id,
       cast(floor((o_orderkey % 1500) / 50) as int) as y,
       cast(o_orderkey % 50 as int) as x,
       cast(case when o_orderkey % 101 = 0 then 254 when o_orderkey % 103 = 0 then 7
                 when o_orderkey % 107 = 0 then 300 when o_orderstatus = 'O' then 0
                 when o_orderstatus = 'F' then 1 else -9999 end as double) as raw_label
from {orders}""",
    "overrides": """
select concat('img_', lpad(cast(image_id as string), 4, '0'), '.tif') as name,
       case when image_id % 4 = 1 then 'validation' else 'training' end as role
from (select distinct cast(floor(o_orderkey / 1500) as int) as image_id from {orders}) s
where image_id % 4 = 1 or image_id % 6 = 5
union all select 'gone.tif' as name, 'validation' as role""",
    "edits": """
select event_id as seq, ts, cast(user_id % 10 as int) as image_id,
       case when event_type = 'signup' then 'clear' else 'stamp' end as kind,
       case event_type when 'click' then 0 when 'purchase' then 0 when 'view' then 1 else 255 end
         as value,
       cast(event_id * 7 % 50 as double) + 0.25 as cx,
       cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 30 as double) + 0.25 as cy,
       cast(1 + event_id % 3 as double) as r
from {events}""",
    "strokes": """
select cast(floor(event_id / 5) as int) as stroke_id, cast(event_id % 5 as int) as pos,
       cast(floor(event_id / 5) % 10 as int) as image_id,
       cast(event_id * 7 % 50 as double) + 0.25 as cx,
       cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 30 as double) + 0.25 as cy,
       cast(1 + floor(event_id / 5) % 3 as double) as r
from {events}""",
    "polygons": """
select cast(floor(event_id / 4) as int) as poly_id, cast(event_id % 4 as int) as vertex,
       cast(floor(event_id / 4) % 10 as int) as image_id,
       cast(event_id * 13 % 50 as double) + 0.25 as vx,
       cast(cast(regexp_extract(props, '([0-9]+)', 1) as int) % 30 as double) + 0.25 as vy
from {events}""",
    "grid_vec": """
select vec_id, cast(floor(vec_id / 25) as int) as gy, cast(vec_id % 25 as int) as gx,
       embedding as vec, label
from {embeddings}""",
    "eval_docs": """
select d.source as image_id, d.doc_id,
       case when l.toxic = 1 then 0 when l.toxic = 0 then 1 else 255 end as label,
       case when d.n_chars % 3 = 0 then 0 else 1 end as cls,
       d.n_chars >= 20 as valid
from {documents} d left join {labels} l on d.doc_id = l.doc_id""",
    "epoch_log": """
select user_id as run_id,
       cast(row_number() over (partition by user_id order by event_id) as int) as epoch,
       cast(count(*) over (partition by user_id) as int) as epochs,
       case when event_type = 'signup' then null else value / (value + 30.005) end as iou
from {events}""",
    "batch_log": """
select user_id as run_id, cast(floor(event_id / 500) as int) as epoch,
       value / 100 as loss_sup,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) as inter,
       cast(regexp_extract(props, '([0-9]+)', 1) as int) + event_id % 7 as uni
from {events}""",
}

# Clicks per scene, derived from the pixels themselves: the scene corner, the pixel at (7, 11),
# and the first invalid pixel are positive, the pixel at (20, 30) is negative.
VIEWS["clicks"] = """
select image_id * 10 + 1 as sample_id, image_id, 0 as y, 49 as x, true as positive
from ({scenes}) a
union all
select image_id * 10 + 2, image_id, 7, 11, true from ({scenes}) b
union all
select image_id * 10 + 3, image_id, cast(floor(k / 50) as int), cast(k % 50 as int), true
from (select cast(floor(o_orderkey / 1500) as int) as image_id, min(o_orderkey % 1500) as k
      from {orders} where o_orderkey % 17 = 0
      group by cast(floor(o_orderkey / 1500) as int)) c
union all
select image_id * 10 + 4, image_id, 20, 30, false from ({scenes}) d"""


def _expand(name: str, table) -> str:
    def put(found: re.Match) -> str:
        key = found.group(1)
        return _expand(key, table) if key in VIEWS else table(key)

    return re.sub(r"\{(\w+)\}", put, VIEWS[name])


def duck_view(name: str) -> str:
    return _expand(name, lambda t: t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_expand(name, lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel table in its working layout: bands as one array."""
    return view(spark, sf_dir, "px").select(
        "image_id", "y", "x", F.array("b0", "b1", "b2", "b3").alias("bands")
    )


def fixture_logits():
    """Linear logits of the fixture model on normalised bands."""
    n = [F.get("norm", i) for i in range(4)]
    return F.array(2 * n[0] - n[1] + 0.5 * n[2], 0.3 + 0.2 * n[3])


def fixture_model(cube):
    """The same model on patches, for `score_patches`."""
    import numpy as np

    n0, n1, n2, n3 = (cube[:, i] for i in range(4))
    return np.stack([2 * n0 - n1 + 0.5 * n2, 0.3 + 0.2 * n3], axis=1)


def neighbour_model(cube):
    """Mean of the fixture model's logits over the 3 by 3 pixels around each, zero outside the window."""
    import numpy as np

    z = np.pad(fixture_model(cube), ((0, 0), (0, 0), (1, 1), (1, 1)))
    h, w = cube.shape[2:]
    return sum(z[:, :, a:a + h, b:b + w] for a in range(3) for b in range(3)) / 9
