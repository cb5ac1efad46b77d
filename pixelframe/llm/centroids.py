"""Centroid clustering with exact whole numbers, nearest centroids by progressive Walsh-Hadamard search.

The transform's rows, in order of sign changes, give coefficients from coarse to fine; squared distances between
transforms are 64 times those between vectors, exactly. A vector's differences to the centroids accumulate coefficient by
coefficient. A centroid whose sum so far exceeds the whole distance of another one is strictly worse and leaves; the others
get all 64 coefficients, and ties go to the smaller number.

Vectors are packed once, as transforms in blocks; each round reads the blocks where they are and sends on a count and 64
sums for each task and cluster. Only centroids come to the driver.

Kept are rows with an id and exactly `width` components, none null or non-finite. Repeated rows count each; where the
starting order ties, the smaller vector comes first. With fewer vectors than `k` every one starts a cluster.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import table
from pixelframe.llm.vectors import EXACT, Block, blocks, unpack, whole
from pixelframe.session import cut

WIDTH, BLOCK = 64, 4096
STAGES = (4, 16, 64)  # coefficients after which centroids leave
ENDS = np.iinfo(np.int64)


def walsh(width: int = WIDTH) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by the number of their sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")]


def transform(data: np.ndarray) -> np.ndarray:
    """Coefficients of each row, exact; as Python's whole numbers where long could overflow in a squared distance."""
    most = float(np.abs(data.astype(float)).max(initial=0.0))
    if 4 * most**2 * data.shape[1] ** 3 < EXACT:
        return (data.astype(float) @ walsh(data.shape[1]).T.astype(float)).astype(np.int64)
    return data.astype(object) @ walsh(data.shape[1]).T.astype(object)


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences between all rows of `a` and of `b`, exact."""
    kind = object if a.dtype == object or b.dtype == object else float
    a, b = a.astype(kind), b.astype(kind)
    out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return out if kind is object else out.astype(np.int64)


def nearest(coefficients: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid, of transforms; ties by the smaller number."""
    n, width = coefficients.shape
    each = np.arange(n)
    total = differences(coefficients[:, :STAGES[0]], centroids[:, :STAGES[0]])
    # The most promising centroid's whole distance is what the others must not exceed.
    lead = total.argmin(axis=1)
    gap = coefficients - centroids[lead]
    bound = (gap * gap).sum(axis=1)
    row, number = np.nonzero(total <= bound[:, None])
    total = total[row, number]
    for low, high in zip(STAGES, (*STAGES[1:], width)):
        if low >= high:
            break
        gap = coefficients[row, low:high] - centroids[number, low:high]
        total = total + (gap * gap).sum(axis=1)
        stay = total <= bound[row]
        row, number, total = row[stay], number[stay], total[stay]
    order = np.lexsort((number, total.astype(object) if total.dtype == object else total, row))
    first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if n else order
    assert n == 0 or (row[first] == each).all()
    return number[first], total[first] // width


def load(row: dict) -> tuple[Block, np.ndarray]:
    block = unpack(row)
    return block, transform(block.data)


def summer(centroids: np.ndarray):
    """Blocks to (cluster, n, s0, s1, ...) of one task: how many vectors each cluster got, and their sums."""
    turned = transform(centroids)

    def total(batches):
        k, width = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), object)
        for batch in batches:
            for i in range(batch.num_rows):
                block, coefficients = load(batch.slice(i, 1).to_pylist()[0])
                kind = block.data.astype(object) if coefficients.dtype == object else block.data
                mixed = same_kind(coefficients, turned)
                number, _ = nearest(*mixed)
                part = np.zeros((k, width), kind.dtype)
                np.add.at(part, number, kind)
                sums += part
                counts += np.bincount(number, minlength=k)
        got = np.flatnonzero(counts)
        columns = [pa.array(got, pa.int32()), pa.array(counts[got])]
        columns += [pa.array([str(x) for x in sums[got, j]], pa.string()) for j in range(width)]
        yield pa.record_batch(columns, names=["cluster", "n", *[f"s{j}" for j in range(width)]])

    return total


def same_kind(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a.astype(object), b.astype(object)) if object in (a.dtype, b.dtype) else (a, b)


def assigner(centroids: np.ndarray):
    turned = transform(centroids)

    def assign(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, coefficients = load(batch.slice(i, 1).to_pylist()[0])
                number, distance = nearest(*same_kind(coefficients, turned))
                distance = np.clip(distance, ENDS.min, ENDS.max).astype(np.int64)
                yield pa.record_batch([pa.array(block.ids), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return assign


def start(rows: DataFrame, k: int) -> np.ndarray:
    """The `k` vectors of smallest sha256 of "2:<vec_id>", as rows."""
    rank = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), WIDTH)


def moved(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of each one's vectors; one without vectors stays."""
    width = centroids.shape[1]
    schema = "cluster int, n long, " + ", ".join(f"s{j} string" for j in range(width))
    parts = packed.mapInArrow(summer(centroids), schema).groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
    out = centroids.copy()
    for r in parts.collect():  # a row for each cluster
        out[r.cluster] = [int(r[f"s{j}"]) // r.n for j in range(width)]
    return out


def cluster(rows: DataFrame, k: int, rounds: int, per_block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each of `rows`."""
    kept = rows.where(F.size("v") == WIDTH)
    centroids = start(kept, k)
    if not len(centroids):
        return kept.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"))
    packed = cut(blocks(kept, per_block))
    for _ in range(rounds):
        centroids = moved(packed, centroids)
    assigned = cut(packed.mapInArrow(assigner(centroids), "vec_id long, cluster int, distance long"))
    sums = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, sums[i], sum(sums.values()), digests[i]) for i in sorted(sums)]  # k rows at most
    known = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(whole(table(spark, sf_dir, "embeddings"), "embedding", 256, "vec_id"), 40, 5)


def _oracle(k: int = 40, rounds: int = 5) -> str:
    parts = ["""v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"""c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), v) - 1 as cluster, v as c
  from v qualify cluster < {k})"""]
    for n in range(rounds + 1):
        parts.append(f"""d{n} as (select vec_id, v, cluster, cast(list_sum(list_transform(list_zip(v, c),
    lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as distance from v join c{n} on true),
a{n} as materialized (select * from d{n} qualify row_number() over (partition by vec_id order by distance, cluster) = 1)""")
        if n < rounds:
            parts.append(f"""e{n} as (select cluster, unnest(range(1, 65)) as i, unnest(v) as x from a{n}),
s{n} as (select cluster, i, cast(sum(x) as bigint) as s, count(*) as n from e{n} group by cluster, i),
m{n} as (select cluster, list((s - ((s % n) + n) % n) // n order by i) as m from s{n} group by cluster),
c{n + 1} as materialized (select cluster, coalesce(m, c) as c from c{n} left join m{n} using (cluster))""")
    return f"with {', '.join(parts)} " + f"""
select vec_id, cast(cluster as int) as cluster, distance,
       cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia,
       cast(sum(distance) over () as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{rounds} join c{rounds} using (cluster)
"""


ORACLE = _oracle()
