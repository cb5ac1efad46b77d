"""Exact top-k inner products, vectors in order of falling length.

Lengths bound products (Cauchy-Schwarz), so the longest vectors are searched first. Vectors are turned into the basis
of their singular vectors, where the leading coordinates hold most of every product: a pair's partial product and the
lengths of what is left bound its whole one, and a pair leaves as soon as that bound is below the query's k-th score so
far. Pairs that stay to the end are scored in whole numbers, so results are exact; bounds carry a slack above the
rounding of doubles.

The search goes by rounds over pieces of the vectors, longest first, each round eight times the one before. Between rounds
every query's k-th score is carried on; a block of queries that no remaining vector can serve takes no part any more.

Rows without id or vector, or with a null or non-finite component, take no part. Vectors of unequal width are filled up
with zeros. Equal rows are separate candidates of each other; ties go to the smaller vec_id. A score beyond the range of
long becomes its end. An empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import table
from pixelframe.llm.vectors import FIELDS, NAMES, Block, best, matrix, meet, numbered, products, stream, whole
from pixelframe.session import cut

QUERIES, CANDIDATES, PIECE = 1024, 2048, 8192  # vectors in a block of queries, of candidates, and in a piece
STEPS = (16, 32)  # leading coordinates after which bounds are tried
GROWTH = 8
AT_ONCE = 1 << 15  # pairs whose coordinates are gathered together
HITS = "qb long, query long, query_id long, vec_id long, score long, length double"


def second_moments(batches):
    """The sums of x_i * x_j over a task's vectors, a row for each i."""
    total = np.zeros((0, 0))
    for batch in batches:
        data = matrix(batch.column("v")).astype(float)
        wide = max(len(total), data.shape[1])
        grown = np.zeros((wide, wide))
        grown[:len(total), :len(total)] = total
        grown[:data.shape[1], :data.shape[1]] += data.T @ data
        total = grown
    i, j = np.indices(total.shape).reshape(2, -1)
    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])


def rotation(rows: DataFrame) -> np.ndarray:
    """Right singular vectors of all vectors as columns, greatest singular value first: width x width numbers."""
    sums = rows.select("v").mapInArrow(second_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    width = max((r.i for r in sums), default=-1) + 1
    moments = np.zeros((width, width))
    for r in sums:
        moments[r.i, r.j] = r.s
    scale = np.abs(moments).max(initial=0.0) or 1.0
    return np.linalg.eigh((moments + moments.T) / (2 * scale))[1][:, ::-1]


class Turned:
    """A block in the rotated basis, with the length left after each of the steps."""

    def __init__(self, block: Block, basis: np.ndarray):
        self.at = block.data.astype(float) @ basis[:block.data.shape[1]]
        self.length = np.sqrt((self.at**2).sum(axis=1))
        self.left = [np.sqrt((self.at[:, s:] ** 2).sum(axis=1)) for s in STEPS]


def searcher(basis: np.ndarray, k: int):
    def found(queries: Block, turned: Turned, least: np.ndarray, block: Block):
        """Pairs (query, candidate, score) of a block that may be among the k best; all of them, or a few more."""
        there = Turned(block, basis)
        slack = 1e-9 * turned.length[:, None] * max(1.0, there.length.max(initial=0.0)) + 1e-6
        floor = least[:, None] - slack
        partial = turned.at[:, :STEPS[0]] @ there.at[:, :STEPS[0]].T
        live = partial + turned.left[0][:, None] * there.left[0] >= floor
        _, i, j = np.intersect1d(queries.rows, block.rows, return_indices=True)
        live[i, j] = False
        if live.sum() * 8 > live.size:
            scores = products(queries.data, block.data)
            live &= scores >= least[:, None]
            if live.shape[1] > k and live.sum() > 4 * k * len(live):  # only a block's own k best can count; ties with the k-th stay
                masked = np.where(live, scores, np.iinfo(np.int64).min)
                kth = np.partition(masked, -k, axis=1)[:, -k]
                live &= scores >= kth[:, None]
            q, c = np.nonzero(live)
            return q, c, scores[q, c]
        q, c = np.nonzero(live)
        out = []
        for lo in range(0, len(q), AT_ONCE):
            a, b = q[lo:lo + AT_ONCE], c[lo:lo + AT_ONCE]
            done = partial[a, b]
            for n, step in enumerate(STEPS[1:], 1):
                done = done + np.einsum("ij,ij->i", turned.at[a, STEPS[n - 1]:step], there.at[b, STEPS[n - 1]:step])
                stay = done + turned.left[n][a] * there.left[n][b] >= floor[a, 0]
                a, b, done = a[stay], b[stay], done[stay]
            done = done + np.einsum("ij,ij->i", turned.at[a, STEPS[-1]:], there.at[b, STEPS[-1]:])
            stay = done >= floor[a, 0]
            a, b = a[stay], b[stay]
            out.append((a, b, pairwise(queries.data[a], block.data[b])))
        if not out:
            return q[:0], c[:0], np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(batches):
        for qb, queries, shown in stream(batches):
            turned, n = Turned(queries, basis), len(queries.rows)
            least = np.frombuffer(queries.extra, float).copy()
            q, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
            for block in shown:
                if (turned.length * block.longest * (1 + 1e-9) + 1e-6 < least).all():
                    break  # the rest of the piece is no longer
                a, b, s = found(queries, turned, least, block)
                q, ids, scores = np.r_[q, a], np.r_[ids, block.ids[b]], np.r_[scores, s]
                top = best(q, scores, ids, k)
                q, ids, scores = q[top], ids[top], scores[top]
                kth = np.full(n, np.inf)
                np.minimum.at(kth, q, scores.astype(float))
                full = np.bincount(q, minlength=n) == k
                least[full] = np.maximum(least[full], np.nextafter(kth[full], -np.inf))
            columns = [np.full(len(q), qb), queries.rows[q], queries.ids[q], ids, scores]
            yield pa.record_batch(
                [pa.array(x, t) for x, t in zip([*columns, turned.length[q]], [*[pa.int64()] * 5, pa.float64()])],
                names=[x.split()[0] for x in HITS.split(", ")],
            )

    return search


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner product of each row of `a` with the same row of `b`."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a.astype(float)).max(initial=0.0)) * float(np.abs(b.astype(float)).max(initial=0.0)) * width < 2.0**53:
        return np.einsum("ij,ij->i", a, b)
    ends = np.iinfo(np.int64)
    return np.clip((a.astype(object) * b.astype(object)).sum(axis=1), ends.min, ends.max).astype(np.int64)


def thresholds(batches):
    """Query blocks with the k-th scores so far (`state`: query, score) to blocks with one number per query as bytes."""
    for batch in batches:
        extra = []
        for row in batch.select(["rows", "state"]).to_pylist():
            known = {x["query"]: x["score"] for x in row["state"] or ()}
            queries = np.frombuffer(row["rows"], np.int64).tolist()
            # A tie may win by its id, and a long may be rounded as a double: the next double below.
            extra.append(np.array([np.nextafter(float(known[q]), -np.inf) if q in known else -np.inf for q in queries]).tobytes())
        rest = [batch.column(c) for c in batch.schema.names if c != "state"]
        yield pa.record_batch([*rest, pa.array(extra, pa.binary())], names=[*(c for c in batch.schema.names if c != "state"), "extra"])


def top_k(rows: DataFrame, is_query: Column, k: int, queries_per_block: int = QUERIES, per_block: int = CANDIDATES, per_piece: int = PIECE) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows of greatest inner product with each query, itself left out.

    `rows` as `vectors.whole` gives them.
    """
    n = rows.count()
    asked = rows.where(is_query)
    basis = rotation(rows)
    candidates = numbered(rows, per_block, -(-n // per_piece) or 1, "part", longest_first=True)
    queries = numbered(asked, queries_per_block, 1 + asked.count() // (8 * queries_per_block), "piece", True, whole_blocks=True)
    queries = queries.withColumnRenamed("at", "qb")
    sizes = candidates.agg(F.max("part").alias("last")).first()
    parts = 0 if sizes["last"] is None else sizes["last"] + 1
    hits = rows.sparkSession.createDataFrame([], HITS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    low, width = 0, 1
    while low < parts:
        high = min(parts, low + width)
        longest = candidates.where(F.col("part") >= low).agg(F.max("longest").alias("l")).first()["l"] or 0.0
        full = hits.where(F.col("rank") == k) if low else None
        if full is None:
            state = queries.select("qb", F.lit(None).cast("array<struct<query:long,score:long>>").alias("state"), F.lit(0).alias("done"))
        else:
            reach = F.col("length") * longest * (1 + 1e-9) + 1e-6
            state = full.groupBy("qb").agg(
                F.collect_list(F.struct("query", "score")).alias("state"), F.count_if(reach < F.col("score")).alias("done"))
        known = queries.join(state, "qb", "left").where(F.coalesce("done", F.lit(0)) < F.col("n"))
        live = known.select("qb", *NAMES, "state").mapInArrow(thresholds, f"qb long, {FIELDS}, extra binary")
        pairs = known.select("qb", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("part"))
        found = meet(pairs, live, candidates).mapInArrow(searcher(basis, k), HITS)
        hits = cut(hits.select(*found.columns).unionByName(found).withColumn("rank", rank).where(F.col("rank") <= k))
        low, width = high, width * GROWTH
    if not parts:
        hits = hits.withColumn("rank", F.lit(0))
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"), "embedding", 64, "vec_id")
    return top_k(rows, F.col("vec_id") % 20 == 0, 20)


ORACLE = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
        cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as int) as rank, vec_id, score from r where n <= 20
"""
