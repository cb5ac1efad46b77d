"""Hard negatives, inner products and centroid clustering beside brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelframe.llm import centroids, innerproduct, negatives
from pixelframe.llm.vectors import best, products, whole
from edge_cases import result

CLASHING = ["row", "v", "mark", "part", "at", "qb", "n", "ids", "rank", "score", "cluster", "extra"]
SCHEMA = "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in CLASHING)
NAN, INF = float("nan"), float("inf")


def rows_with_edges(width=64, n=400, seed=5):
    """Vectors of many lengths and directions, copies of one, ties, repeated rows, and rows that take no part."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0.1, 1, 1, 3])
        rows.append((i, [rng.gauss(0, size) / math.sqrt(width) * (1 + 8 * (j < 3)) for j in range(width)], rng.choice([0, 1, 2, 9])))
    hot = rows[3][1]
    rows += [(n + i, hot, 1) for i in range(150)]  # a third of all rows is one vector
    rows += [rows[0], rows[0], rows[50], rows[120], (140, rows[7][1], 2)]  # equal rows, and one id with two vectors
    rows += [(1000, [0.0] * width, 1), (1100, [0.0] * width, 0), (1200, [-x for x in hot], 1)]
    out = [(1300, None, 1), (1400, [NAN] * width, 1), (1500, hot[:-1] + [INF], 0), (1600, hot[:-1] + [None], 0), (None, hot, 1)]
    rows += out
    rng.shuffle(rows)
    return [r + ("clash",) * len(CLASHING) for r in rows]


RAGGED = [(1700, [], 1), (1750, [1.5, -2.0], 1), (1800, [0.25] * 70, 0), (1850, [None], 1)]


def usable(rows, scale, label=False):
    out = []
    for vec_id, vec, mark, *_ in rows:
        if vec_id is None or vec is None or any(x is None or not math.isfinite(x) for x in vec) or (label and mark is None):
            continue
        mark = (mark + 1) % 10 if label and vec_id % 7 == 0 else mark
        out.append((vec_id, [math.floor(scale * float(np.float32(x))) for x in vec], mark))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def top_by_hand(rows, k):
    rows, out = usable(rows, 64), Counter()
    for i, (query_id, v, _) in enumerate(rows):
        if query_id % 20 == 0:
            all_ = sorted((-dot(v, w), c) for j, (c, w, _) in enumerate(rows) if j != i)
            out.update((query_id, n, c, -s) for n, (s, c) in enumerate(all_[:k], 1))
    return out


def mined_by_hand(rows, every):
    rows, out = usable(rows, 256, True), Counter()
    for i, (anchor, v, label) in enumerate(rows):
        if anchor % every:
            continue
        all_ = sorted((-dot(v, w), c, m) for j, (c, w, m) in enumerate(rows) if j != i)
        for ps, positive, _ in [x for x in all_ if x[2] == label][:5]:
            inside = [(ns, c) for ns, c, m in all_ if m != label and 50 * -ps <= 100 * -ns <= 95 * -ps]
            out.update((anchor, positive, n, c, -ps, -ns) for n, (ns, c) in enumerate(inside[:3], 1))
    return out


def clusters_by_hand(rows, k=40, rounds=5):
    rows = [(i, v) for i, v, _ in usable(rows, 256) if len(v) == 64]
    first = sorted(rows, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in first]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centres)) for _, v in rows]

    for _ in range(rounds):
        near = assign()
        for n in range(len(centres)):
            mine = [v for (_, v), (_, m) in zip(rows, near) if m == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine)]
    near = assign()
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(rows, near))


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) + ("clash",) * (len(CLASHING) + 3 - len(r)) for r in rows], SCHEMA).repartition(3)


TOP = ("query_id", "rank", "vec_id", "score")
MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
DIVISIBLE = "vec_id % 20 = 0"


@pytest.mark.parametrize("sizes", [(1024, 2048, 8192), (4, 16, 60)])
@pytest.mark.parametrize("ragged", [[], RAGGED])
def test_top_k(spark, sizes, ragged):
    rows = rows_with_edges() + ragged
    got = innerproduct.top_k(whole(frame(spark, rows), "embedding", 64, "vec_id"), DIVISIBLE, 20, *sizes)
    assert result(got, *TOP) == top_by_hand(rows, 20)


def test_top_k_prunes_by_length_and_partial_products(spark):
    """A few long vectors serve every query: blocks of short ones are not scored, and bounds leave few pairs."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) + (40 if i < 60 and j == i % 2 else 0) for j in range(64)], 0) for i in range(900)]
    got = innerproduct.top_k(whole(frame(spark, rows), "embedding", 64, "vec_id"), DIVISIBLE, 20, 16, 32, 64)
    assert result(got, *TOP) == top_by_hand(rows, 20)


def test_whole_numbers_of_any_size(spark):
    rows = [(i, [(-1.0) ** i * 2.0**e] * 3, i % 3) for i, e in enumerate([0, 20, 40, 50, 57, 60, 100, 120] * 3)]
    ends = 2**63 - 1
    clip = lambda s: max(-ends - 1, min(ends, s))
    vectors = [(i, [max(-ends - 1, min(ends, math.floor(64 * x))) for x in v]) for i, v, _ in rows]
    want = Counter()
    for q, v in vectors:
        if q % 20 == 0:
            all_ = sorted((-clip(dot(v, w)), c) for c, w in vectors if c != q)
            want.update((q, n, c, -s) for n, (s, c) in enumerate(all_[:20], 1))
    got = innerproduct.top_k(whole(frame(spark, rows), "embedding", 64, "vec_id"), DIVISIBLE, 20)
    assert result(got, *TOP) == want


@pytest.mark.parametrize("sizes", [(512, 2048, 8192), (3, 16, 60)])
@pytest.mark.parametrize("ragged", [[], RAGGED])
def test_hard_negatives(spark, sizes, ragged):
    rows = rows_with_edges(n=300, width=24 if ragged else 64) + ragged + [(1950, [1.0] * 24, None)]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = whole(frame(spark, rows), "embedding", 256, "vec_id", label)
    got = negatives.hard_negatives(vectors, F.col("vec_id") % 10 == 0, 5, 3, *sizes)
    assert result(got, *MINED) == mined_by_hand(rows, 10)


def test_windows_are_exact():
    for score in [-(2**63), -7, -1, 0, 1, 2, 99, 100, 101, 2**62 + 1, 2**63 - 1]:
        low, high = negatives.window(np.array([score]))
        assert (int(low[0]), int(high[0])) == (-(-50 * score // 100), 95 * score // 100)


def test_packed_keys_sort_as_tuples():
    rng = random.Random(2)
    ends = [-(2**63), 2**63 - 1, 0, -1, 1]
    draw = lambda: rng.choice(ends + [rng.randrange(-(2**40), 2**40)])
    rows = [(draw(), rng.randrange(2**40), draw(), rng.random() < 0.5, draw()) for _ in range(300)]
    keys = negatives.pack_keys(*(np.array(c) for c in zip(*rows)))
    order = sorted(range(300), key=lambda i: keys[i])
    assert [rows[i] for i in order] == sorted(rows, key=lambda r: (r[0], r[1], -max(r[2], 1 - 2**63), r[3], r[4]))
    assert all(negatives.unpack_key(k)[:2] == r[:2] for k, r in zip(keys, rows))


@pytest.mark.parametrize("per_block", [4096, 23])
def test_clusters(spark, per_block):
    rows = rows_with_edges() + RAGGED
    got = centroids.cluster(whole(frame(spark, rows), "embedding", 256, "vec_id"), 40, 5, per_block)
    assert result(got, *CLUSTERS) == clusters_by_hand(rows)


def test_few_and_large_vectors(spark):
    few = [(i, [float(i)] * 64, 0) for i in range(7)] + [(3, [9.0] * 64, 0)]
    got = centroids.cluster(whole(frame(spark, few), "embedding", 256, "vec_id"), 40, 5)
    assert result(got, *CLUSTERS) == clusters_by_hand(few)
    large = [(i, [2.0**30 * ((i * j) % 5 - 2) for j in range(64)], 0) for i in range(60)]
    got = result(centroids.cluster(whole(frame(spark, large), "embedding", 256, "vec_id"), 40, 5), "vec_id", "cluster", "centroid_sha256")
    assert got == Counter((i, n, h) for i, n, _, _, _, h in clusters_by_hand(large).elements())


def test_empty_tables(spark):
    none = whole(spark.createDataFrame([], SCHEMA), "embedding", 64, "vec_id")
    assert innerproduct.top_k(none, DIVISIBLE, 20).collect() == []
    assert negatives.hard_negatives(none, DIVISIBLE).collect() == []
    assert centroids.cluster(none, 40, 5).collect() == []
    alone = whole(frame(spark, [(20, [1.0, 2.0], 1)]), "embedding", 64, "vec_id")
    assert innerproduct.top_k(alone, DIVISIBLE, 20).collect() == []
    assert negatives.hard_negatives(alone, DIVISIBLE).collect() == []


def test_walsh_rows_go_from_coarse_to_fine():
    h = centroids.walsh(64)
    assert (h @ h.T == 64 * np.eye(64)).all()
    assert (np.diff(h, axis=1) != 0).sum(axis=1).tolist() == list(range(64))


def test_progressive_search_drops_strictly_worse_only():
    rng = np.random.default_rng(4)
    data, centres = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (40, 64))
    centres[7] = centres[3]
    data[5] = centres[3]
    number, distance = centroids.nearest(centroids.transform(data), centroids.transform(centres))
    whole_ = ((data[:, None] - centres) ** 2).sum(axis=2)
    assert (number == whole_.argmin(axis=1)).all() and (distance == whole_.min(axis=1)).all()
    assert number[5] == 3 and distance[5] == 0


def test_best_and_products():
    group, score, ids = np.array([1, 0, 1, 1, 0]), np.array([5, 2, 5, 9, 2]), np.array([8, 4, 2, 1, 3])
    assert best(group, score, ids, 2).tolist() == [4, 1, 3, 2]
    low = np.iinfo(np.int64).min
    assert best(np.zeros(3, int), np.array([low, 4, low + 1]), np.arange(3), 3).tolist() == [1, 2, 0]
    assert len(best(group[:0], score[:0], ids[:0], 2)) == 0
    assert products(np.array([[2**40, 1]]), np.array([[2**40, 5]])).tolist() == [[2**63 - 1]]
    assert products(np.array([[2**30, 1]]), np.array([[2**30, 5]])).tolist() == [[2**60 + 5]]
