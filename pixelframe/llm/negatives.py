"""Hard negatives: rows of another label that score almost as an anchor's positives do.

Blocks of anchors meet blocks of all rows twice. The first pass keeps, for each anchor, the best rows of its own label;
merged, they are its positives, and each one's score opens a window of scores for negatives. The second pass keeps, of each
group of blocks and window, the best rows of other labels, which is all that a result can need. These pairs are packed into
keys of anchor, falling score and id, sorted in the shuffle (repartitionAndSortWithinPartitions), and one iterator per
partition reads them once: a positive opens its window, a negative is told to the open windows that hold it, and nothing of
an anchor is kept but its few windows.

Rows without id, label or vector, or with a null or non-finite component, take no part. Equal rows are rows of their own;
ties go to the smaller vec_id. Vectors of unequal width are filled up with zeros. A score beyond the range of long becomes its
end. An anchor without positives, or a positive without negatives in its window, gives no row.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import shuffle_width, table
from pixelframe.llm.vectors import FIELDS, NAMES, best, meet, numbered, products, stream, whole
from pixelframe.session import cut

ANCHORS, CANDIDATES, PIECE = 512, 2048, 8192  # vectors in a block of anchors, of candidates, and in a piece
LOW, HIGH = 50, 95  # percent of a positive's score between which negatives lie
PAIRS = "anchor long, anchor_id long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FIRST = 1 << 63


def window(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative: 100 times it lies between LOW and HIGH times the positive's."""
    whole_part, rest = score // 100, score % 100
    return whole_part * LOW - (-rest * LOW // 100), whole_part * HIGH + rest * HIGH // 100


def scored(anchors, block):
    """Scores of all pairs, and which pairs are of one label; an anchor and itself is neither."""
    scores = products(anchors.data, block.data)
    same = anchors.marks[:, None] == block.marks
    _, i, j = np.intersect1d(anchors.rows, block.rows, return_indices=True)
    other = ~same
    same[i, j] = False
    return scores, same, other


def leaders(scores: np.ndarray, among: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) of the `k` best scores `among` each row."""
    if among.shape[1] > k and among.sum() > 4 * k * len(among):
        masked = np.where(among, scores, np.iinfo(np.int64).min)
        among = among & (scores >= np.partition(masked, -k, axis=1)[:, -k][:, None])  # ties with the k-th stay
    a, c = np.nonzero(among)
    top = best(a, scores[a, c], ids[c], k)
    return a[top], c[top]


def positive_finder(k: int):
    def find(batches):
        for _, anchors, shown in stream(batches):
            a, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
            for block in shown:
                s, same, _ = scored(anchors, block)
                i, j = leaders(s, same, block.ids, k)
                a, ids, scores = np.r_[a, i], np.r_[ids, block.ids[j]], np.r_[scores, s[i, j]]
                top = best(a, scores, ids, k)
                a, ids, scores = a[top], ids[top], scores[top]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (anchors.rows[a], anchors.ids[a], ids, scores)], names=[x.split()[0] for x in PAIRS.split(", ")])

    return find


def pack_keys(anchor_id, anchor, score, negative, vec_id) -> list[bytes]:
    """Byte keys that sort by anchor, falling score, positives first, id."""
    low = 1 - FIRST
    return [
        struct.pack(">QQQ?Q", a + FIRST, r, FIRST - max(s, low), n, v + FIRST)
        for a, r, s, n, v in zip(anchor_id.tolist(), anchor.tolist(), score.tolist(), negative.tolist(), vec_id.tolist())
    ]


def unpack_key(key: bytes) -> tuple[int, int, int, bool, int]:
    a, r, s, n, v = struct.unpack(">QQQ?Q", key)
    return a - FIRST, r, FIRST - s, n, v - FIRST


def with_windows(batches):
    """Anchor blocks with their positives' scores (`state`: anchor, scores) to blocks with those scores as bytes."""
    for batch in batches:
        extra = []
        for row in batch.select(["rows", "state"]).to_pylist():
            known = {x["anchor"]: x["scores"] for x in row["state"] or ()}
            each = [known.get(r, []) for r in np.frombuffer(row["rows"], np.int64).tolist()]
            extra.append(np.r_[[len(x) for x in each], sum(each, [])].astype(np.int64).tobytes())
        rest = [batch.column(c) for c in batch.schema.names if c != "state"]
        yield pa.record_batch([*rest, pa.array(extra, pa.binary())], names=[*(c for c in batch.schema.names if c != "state"), "extra"])


def negative_finder(k: int):
    def find(batches):
        for _, anchors, shown in stream(batches):
            numbers = np.frombuffer(anchors.extra, np.int64)
            n = len(anchors.rows)
            owner = np.repeat(np.arange(n), numbers[:n])  # of each window
            low, high = window(numbers[n:])
            w, rows, ids, scores = (np.zeros(0, np.int64) for _ in range(4))
            for block in shown:
                s, _, other = scored(anchors, block)
                # A block of windows at a time, so that what is compared stays as large as a block of anchors.
                for at in range(0, len(owner), n):
                    own = owner[at:at + n]
                    mine = s[own]
                    inside = other[own] & (mine >= low[at:at + n, None]) & (mine <= high[at:at + n, None])
                    i, j = leaders(mine, inside, block.ids, k)
                    w, rows, ids = np.r_[w, i + at], np.r_[rows, block.rows[j]], np.r_[ids, block.ids[j]]
                    scores = np.r_[scores, mine[i, j]]
                top = best(w, scores, ids, k)
                w, rows, ids, scores = w[top], rows[top], ids[top], scores[top]
            # Windows of an anchor overlap: a pair goes out once.
            a = owner[w]
            _, once = np.unique(np.stack([a, rows]), axis=1, return_index=True)
            a = a[once]
            keys = pack_keys(anchors.ids[a], anchors.rows[a], scores[once], np.ones(len(a), bool), ids[once])
            yield pa.record_batch([pa.array(keys, pa.binary())], names=["key"])

    return find


def positive_keys(batches):
    for batch in batches:
        columns = (batch.column(c).to_numpy() for c in ("anchor_id", "anchor", "score"))
        keys = pack_keys(*columns, np.zeros(batch.num_rows, bool), batch.column("vec_id").to_numpy())
        yield pa.record_batch([pa.array(keys, pa.binary())], names=["key"])


def mined(keys, k: int):
    """Sorted packed keys of whole anchors to rows of RESULT, one pass, open windows in memory only."""
    anchor, windows = None, []
    for key, _ in keys:
        anchor_id, row, score, negative, vec_id = unpack_key(key)
        if row != anchor:
            anchor, windows = row, []
        if not negative:
            low, high = window(np.array([score]))
            windows.append([vec_id, score, int(low[0]), int(high[0]), 0])
            continue
        for w in windows:
            if w[2] <= score <= w[3] and w[4] < k:
                w[4] += 1
                yield anchor_id, w[0], w[4], vec_id, w[1], score


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, anchors_per_block: int = ANCHORS,
                   per_block: int = CANDIDATES, per_piece: int = PIECE) -> DataFrame:
    """RESULT rows: the first `n_negatives` rows of another label inside the window of each of an anchor's `n_positives` positives.

    `rows` as `vectors.whole` gives them, the label as mark.
    """
    spark = rows.sparkSession
    candidates = numbered(rows, per_block, -(-rows.count() // per_piece) or 1, "part")
    asked = rows.where(is_anchor)
    anchors = numbered(asked, anchors_per_block, 1 + asked.count() // (8 * anchors_per_block), "piece", whole_blocks=True)
    anchors = anchors.withColumnRenamed("at", "qb").withColumn("extra", F.lit(None).cast("binary"))
    last = candidates.agg(F.max("part").alias("last")).first()["last"]
    if last is None:
        return spark.createDataFrame([], RESULT)
    pairs = anchors.select("qb", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))

    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    near = meet(pairs, anchors, candidates).mapInArrow(positive_finder(n_positives), PAIRS)
    positives = cut(near.withColumn("rank", rank).where(F.col("rank") <= n_positives).drop("rank"))
    owners = anchors.select("qb", "rows").mapInArrow(members, "qb long, anchor long")
    scores = positives.groupBy("anchor").agg(F.collect_list("score").alias("scores"))
    state = scores.join(owners, "anchor").groupBy("qb").agg(F.collect_list(F.struct("anchor", "scores")).alias("state"))
    opened = anchors.drop("extra").join(state, "qb").select("qb", *NAMES, "state").mapInArrow(with_windows, f"qb long, {FIELDS}, extra binary")
    negatives = meet(pairs.join(state.select("qb"), "qb"), opened, candidates).mapInArrow(negative_finder(n_negatives), "key binary")

    keys = positives.mapInArrow(positive_keys, "key binary").unionByName(negatives)
    by_anchor = keys.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(
        shuffle_width(spark), lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(by_anchor.mapPartitions(lambda sorted_keys: mined(sorted_keys, n_negatives)), RESULT)


def members(batches):
    """Blocks to (qb, anchor): which rows each holds."""
    for batch in batches:
        for qb, rows in zip(batch.column("qb").to_pylist(), batch.column("rows").to_pylist()):
            found = np.frombuffer(rows, np.int64)
            yield pa.record_batch([pa.array(np.full(len(found), qb)), pa.array(found)], names=["qb", "anchor"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = whole(table(spark, sf_dir, "embeddings"), "embedding", 256, "vec_id", label)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
with v as materialized (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
        cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as k
      from p join s using (anchor_id)
      where not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, cast(k as int) as rank, negative_id, positive_score, negative_score from n where k <= 3
"""
