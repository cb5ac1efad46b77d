import math
import random

import numpy as np
import pytest
from geometry import component_labels, flood, frame, mask_rows, points, samples, scene
from pyspark.sql import functions as F

from pixelframe.operators import regions, selection
from pixelframe.plans import graph
from pixelframe.plans.skew import salted_join


def field_of(spark, values, point_list):
    """The given distance field for every sample; a third axis gives one per sample."""
    rows = []
    for i, (_, _, positive) in enumerate(point_list):
        grid = values[i] if values.ndim == 3 else values
        for y in range(grid.shape[0]):
            for x in range(grid.shape[1]):
                rows.append((i, positive, 0, y, x, True, float(grid[y, x])))
    return spark.createDataFrame(
        rows, "sample_id int, positive boolean, image_id int, y int, x int, valid boolean, d double"
    )


def run(spark, values, point_list, tolerance=0.5, **options):
    shape = values.shape[-2:]
    return selection.select(
        frame(spark, *shape, 0.0), samples(spark, point_list), scene(spark, *shape), tolerance,
        fields=field_of(spark, values, point_list), **options,
    )


def test_corner_blocks_are_not_joined(spark):
    # Two blocks that touch at a corner only.
    values = np.ones((40, 40))
    values[10:20, 10:20] = 0
    values[20:30, 20:30] = 0
    got = points(run(spark, values, [(15, 15, True)]).pixels)
    assert got == {(y, x) for y in range(10, 20) for x in range(10, 20)}


def test_labels_conduct_but_are_withheld(spark):
    values = np.ones((60, 20))
    values[5:55, 5:10] = 0
    stripe = np.zeros_like(values, dtype=bool)
    stripe[25:30] = True
    labels = mask_rows(spark, stripe).selectExpr("*", "3 as label")
    got = run(spark, values, [(10, 7, True)], protect=labels)
    stats = got.stats.first()
    assert stats["count"] == 45 * 5 and stats["protected"] == 25 and stats["available"] == 250
    assert (40, 7) in points(got.pixels) and (27, 7) not in points(got.pixels)


def test_negative_cuts_every_fragment(spark):
    first, second = np.ones((40, 60)), np.ones((40, 60))
    for y, x in ((4, 4), (20, 20), (30, 50)):
        first[y:y + 6, x:x + 6] = 0
    for y, x in ((20, 20), (30, 50)):
        second[y:y + 6, x:x + 6] = 0
    both = np.stack([first, second])
    got = run(spark, both, [(5, 5, True), (21, 21, False)], is_global=True)
    assert points(got.pixels) == {(y, x) for y in range(4, 10) for x in range(4, 10)}


def test_options_contract(spark):
    values = np.ones((4, 4))
    for options, text in [
        ({"budget": 0}, "max_pixels must be positive"),
        ({"budget": "x"}, "max_pixels must be an integer or null"),
        ({"sample_size": "x"}, "sample_size must be an integer"),
        ({"source": "x"}, "Unknown wand source: x"),
        ({"level": "x"}, "Unknown feature level: x"),
        ({"tolerance": "x"}, "A numeric tolerance is required"),
    ]:
        with pytest.raises(ValueError, match=text):
            run(spark, values, [(1, 1, True)], **options)
    with pytest.raises(ValueError, match="No samples given"):
        run(spark, values, [(1, 1, False)])
    assert selection.clamp_sample_size(99) == 25 and selection.clamp_sample_size(-1) == 1
    assert selection.offsets(5) == [(0, 0), (-1, 0), (0, -1), (0, 1), (1, 0)]


@pytest.mark.parametrize("is_global", [True, False])
@pytest.mark.parametrize("budget", [None, 30])
def test_adding_a_positive_never_removes_a_pixel(spark, is_global, budget):
    rng = np.random.default_rng(1)
    image = rng.random((24, 24)).cumsum(0).cumsum(1)
    image = (image - image.min()) / (image.max() - image.min())
    px, shape = frame(spark, 24, 24, image), scene(spark, 24, 24)
    a, b = (5, 5, True), (18, 12, True)

    def take(*clicks):
        return points(selection.select(
            px, samples(spark, clicks), shape, 0.1, 9, budget, is_global).pixels)

    assert take(a, b) == take(a) | take(b)


@pytest.mark.parametrize("block", [4, 7, 64])
def test_components_equal_flood_fill(spark, block):
    rng = np.random.default_rng(2)
    mask = rng.random((20, 25)) < 0.6
    labelled = regions.components(mask_rows(spark, mask), block=block)
    got = {(r["y"], r["x"]): divmod(r["component"], regions.ROW_STRIDE) for r in labelled.collect()}
    assert got == component_labels(mask)


def test_spiral_component_spans_blocks(spark):
    mask = np.zeros((17, 17), dtype=bool)
    mask[::2] = True
    mask[1::4, -1] = True
    mask[3::4, 0] = True
    labelled = regions.components(mask_rows(spark, mask), block=3)
    assert labelled.select("component").distinct().count() == 1


def serpentine(side):
    """One corridor through the whole square: rows joined at alternating ends."""
    mask = np.zeros((side, side), dtype=bool)
    mask[::2] = True
    mask[1::4, -1] = True
    mask[3::4, 0] = True
    return mask


def test_hooking_rounds_are_logarithmic(spark, monkeypatch):
    mask, rounds = serpentine(400), []
    contract = regions.contract
    monkeypatch.setattr(regions, "contract", lambda links, keys: contract(links, keys, rounds.append))
    labelled = regions.components(mask_rows(spark, mask), block=20)
    assert labelled.groupBy("component").count().collect() == [(0, int(mask.sum()))]
    # 200 corridor rows in 20 blocks each make 4,000 nodes: 12 is their logarithm.
    assert 1 <= len(rounds) <= 12


def test_contraction_of_any_graph(spark):
    """Stars, long paths in bad orders, a hub of thousands of nodes, and parts of several keys."""
    rng = random.Random(5)
    hub = [(5000, i) for i in range(3000)]
    order = list(range(6000, 6400))
    rng.shuffle(order)
    path = list(zip(order, order[1:]))
    chain = [(i, i + 1) for i in range(7000, 7300)]
    few = [(rng.randrange(9000, 9600), rng.randrange(9000, 9600)) for _ in range(400)]
    edges = {(k, a, b) for k, es in enumerate([hub + path, chain + few, path]) for a, b in es if a != b}
    links = spark.createDataFrame(
        sorted(edges | {(k, b, a) for k, a, b in edges}), "k int, a long, b long")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, a, b in edges:
        a, b = find((k, a)), find((k, b))
        parent[max(a, b)] = min(a, b)
    rounds = []
    got = {(r["k"], r["node"]): (r["k"], r["root"]) for r in graph.contract(links, ["k"], rounds.append).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    assert len(rounds) <= 2 * math.ceil(math.log2(len(parent)))


def test_no_hot_root_in_one_task(spark):
    """Joins on a root are salted."""
    left = spark.createDataFrame([(1, i) for i in range(400)], "root long, node long")
    right = spark.createDataFrame([(1, 7)], "root long, _root long")
    joined = salted_join(left, right, ["root"], ["node"])
    assert joined.select("_root").distinct().collect() == [(7,)] and joined.count() == 400
    tasks = left.select(F.pmod(F.xxhash64("node"), F.lit(16)).alias("part")).distinct().count()
    assert tasks == 16


def test_path_frontier_writes_follow_the_frontier(spark, monkeypatch):
    """A corridor is walked block by block, and settled blocks are not written again."""
    mask, written = serpentine(20), []
    add = regions._Store.add

    def counted(store, improved):
        written.append(add(store, improved))
        return written[-1]

    monkeypatch.setattr(regions._Store, "add", counted)
    rows = mask_rows(spark, mask).selectExpr("1 as sample_id", "*")
    seed = spark.createDataFrame([(1, 0, 0, 0)], "sample_id int, image_id int, y int, x int")
    block = 5
    got = {(r["y"], r["x"]): r["dist"] for r in regions.path_distance(rows, seed, block=block).collect()}
    assert got == flood(mask, (0, 0))
    # Each of the three corridor rows that a block holds at most reaches it once more.
    assert sum(written) <= 3 * (20 // block) ** 2 + 20 // block and max(written) <= 2
    del written[:]
    near = {(r["y"], r["x"]) for r in regions.grow(rows, seed, 12, block).collect()}
    assert near == {(0, x) for x in range(12)} and sum(written) <= 4


@pytest.mark.parametrize("block", [4, 32])
@pytest.mark.parametrize("budget", [1, 25, 10 ** 6])
def test_path_budget_equals_breadth_first(spark, block, budget):
    rng = np.random.default_rng(4)
    mask = rng.random((18, 18)) < 0.7
    mask[9, 9] = True
    dist = flood(mask, (9, 9))
    region = np.zeros_like(mask)
    for p in dist:
        region[p] = True
    rows = mask_rows(spark, region).selectExpr("1 as sample_id", "*")
    seed = spark.createDataFrame([(1, 0, 9, 9)], "sample_id int, image_id int, y int, x int")
    got = {(r["y"], r["x"]): r["dist"] for r in regions.grow(rows, seed, budget, block).collect()}
    want = sorted(dist, key=lambda p: (dist[p], p))[:budget]
    assert got == {p: dist[p] for p in want}


def test_region_statistics(spark):
    mask = np.zeros((20, 20), dtype=bool)
    mask[2:7, 3:9] = True
    mask[15, 15] = True
    found = regions.regions(regions.components(mask_rows(spark, mask), block=4), min_area=16)
    rows = found.collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["area"], row["y_min"], row["y_max"], row["x_min"], row["x_max"]) == (30, 2, 6, 3, 8)
    assert row["exposed"] == 2 * (5 + 6) and row["y_mean"] == 4.0 and row["x_mean"] == 5.5


def test_embedding_source_is_bounded_and_seeded(spark):
    rng = np.random.default_rng(6)
    rows = [(0, "fine", y, x, 8, 8, [float(v) for v in rng.normal(size=5)])
            for y in range(8) for x in range(8)]
    feats = spark.createDataFrame(
        rows, "image_id int, level string, gy int, gx int, gh int, gw int, vec array<double>")
    px, shape = frame(spark, 16, 16, 0.0), scene(spark, 16, 16)
    clicks = samples(spark, [(3, 4, True)])
    got = points(selection.select(
        px, clicks, shape, 0.7, source="sam", features=feats, is_global=True).pixels)
    again = points(selection.select(
        px, clicks, shape, 0.7, source="sam", features=feats, is_global=True).pixels)
    assert got == again and (3, 4) in got and 0 < len(got) < 256


def search_twin(vecs, examples, tolerance):
    """Brute force: every row against every example."""
    unit = vecs - vecs.mean(axis=0)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-8)
    signs = {True: [i for i, p in examples if p], False: [i for i, p in examples if not p]}
    found = {}
    for i, row in enumerate(unit):
        d = min(1 - unit[signs[True]] @ row)
        d_neg = min(1 - unit[signs[False]] @ row) if signs[False] else None
        if d <= tolerance and (d_neg is None or d < d_neg):
            found[i] = (round(d, 9), None if d_neg is None else round(d_neg, 9))
    return found


@pytest.mark.parametrize("tolerance,pivots,part", [(0.5, 64, 1024), (0.5, 3, 2), (0.05, 8, 3), (2.0, 1, 1)])
def test_search_by_lists_equals_brute_force(spark, monkeypatch, tolerance, pivots, part):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 6))
    vecs = centres[rng.integers(0, 9, 240)] + rng.normal(size=(240, 6)) * 0.2
    vecs[7], vecs[50] = vecs[6], vecs[40]  # repeated vectors
    examples = [(i, i % 3 != 0) for i in range(60)]
    monkeypatch.setattr(selection, "PIVOTS", pivots)
    monkeypatch.setattr(selection, "LIST_PART", part)
    found = selection.similar(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id int, vec array<double>"),
        spark.createDataFrame(examples, "vec_id int, positive boolean"), tolerance,
    ).collect()
    want = search_twin(vecs, examples, tolerance)
    # A row that is an example itself is 0 away, up to rounding.
    got = {r["vec_id"]: (round(r["d"], 9) + 0.0, round(r["d_neg"], 9) + 0.0) for r in found}
    assert got == {i: (d + 0.0, n + 0.0) for i, (d, n) in want.items()}
    if tolerance == 0.05:  # most lists are out of reach
        assert sum(r["compared"] for r in found) < 0.5 * len(found) * len(examples)


def test_search_without_negatives_nulls_and_top_k(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(20)] + [
        (20, None), (21, [float("nan"), 1.0, 2.0]), (22, [None, 1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id int, vec array<double>")
    examples = spark.createDataFrame([(3, True), (20, True), (21, False)], "vec_id int, positive boolean")
    found = selection.similar(vectors, examples, 1.5, 4).collect()
    vecs = np.array([v for _, v in rows[:20]])
    want = search_twin(vecs, [(3, True)], 1.5)
    assert {r["vec_id"] for r in found} == set(sorted(want, key=lambda i: (want[i][0], i))[:4])
    assert all(r["d_neg"] is None for r in found)
    none = selection.similar(vectors, examples.filter("vec_id > 100"), 1.5)
    assert none.count() == 0


@pytest.mark.parametrize("k,searched", [(8, False), (12, False), (13, True), (40, True)])
def test_closest_rows_meet_no_list_of_positives(spark, monkeypatch, k, searched):
    """Twelve rows lie on a positive example and on no negative one; only a longer top-k reads the lists."""
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(200, 6))
    vecs[100:102] = vecs[0]  # copies that are no examples
    vecs[2], vecs[3] = vecs[20], vecs[21]  # positive and negative alike
    vecs[110] = vecs[5] + 1e-3  # near, but not at no distance
    examples = [(i, i < 12) for i in range(32)]
    signs, lists = [], selection.nearest_example

    def seen(rows, held, directory, positive, *rest):
        signs.append(positive)
        return lists(rows, held, directory, positive, *rest)

    monkeypatch.setattr(selection, "nearest_example", seen)
    found = selection.similar(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id int, vec array<double>"),
        spark.createDataFrame(examples, "vec_id int, positive boolean"), 0.9, k,
    ).collect()
    want = search_twin(vecs, examples, 0.9)
    zeros = {i for i, (d, _) in want.items() if d == 0}
    assert zeros == {0, 1, *range(4, 12), 100, 101} and len(want) > 40
    got = {r["vec_id"]: (round(r["d"], 9) + 0.0, round(r["d_neg"], 9) + 0.0) for r in found}
    assert len(got) == k and all(want[i] == pair for i, pair in got.items())
    assert set(got) <= zeros if k <= 12 else set(got) == set(sorted(want, key=lambda i: (want[i][0], i))[:k])
    assert (True in signs) is searched
    assert searched or max(r["compared"] for r in found) <= 20 + 2


@pytest.mark.parametrize("negatives", [0, 1, 5])
def test_contested_field_equals_all_pairs(spark, monkeypatch, negatives):
    """One bundle of negatives or several: the pixels, distances and least negative distance of all pairs."""
    monkeypatch.setattr(selection, "NEGATIVES_AT_ONCE", 2)
    draw = np.random.default_rng(negatives)
    norm = draw.random((6, 7, 2))
    px = spark.createDataFrame(
        [(0, y, x, (y + x) % 5 > 0, norm[y, x].tolist()) for y in range(6) for x in range(7)],
        "image_id int, y int, x int, valid boolean, norm array<double>")
    vectors = draw.random((2 + negatives, 2))
    refs = spark.createDataFrame(
        [(i, 0, i < 2, v.tolist()) for i, v in enumerate(vectors)],
        "sample_id int, image_id int, positive boolean, ref array<double>")
    got = {(r.sample_id, r.y, r.x): (r.d, r.d_neg) for r in selection.contested_field(px, refs, 0.4).collect()}
    far = np.sqrt(((norm[None] - vectors[:, None, None]) ** 2).mean(-1))
    want = [(i, y, x) for i in range(2) for y in range(6) for x in range(7) if (y + x) % 5 and far[i, y, x] <= 0.4]
    assert sorted(got) == want
    for i, y, x in want:
        d, d_neg = got[i, y, x]
        assert d == pytest.approx(far[i, y, x])
        assert d_neg == (pytest.approx(far[2:, y, x].min()) if negatives else None)
