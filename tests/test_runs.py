import numpy as np
import pandas as pd
import pytest
from geometry import frame, scene
from pyspark.sql import functions as F

from contract.common import normed
from contract.fixtures import view
from pixelframe.functions.hashing import mixed, uniform
from pixelframe.operators import augment, evaluate, learn, monitor, scoring, tiling
from pixelframe.streaming import gate as live


def epochs(spark, values):
    return spark.createDataFrame(
        [(1, i + 1, len(values), v) for i, v in enumerate(values)],
        "run_id long, epoch int, epochs int, iou double")


@pytest.mark.parametrize("values,gate", [
    ([.7, .7, .7, .1], 4), ([.7, .7, None, .7, .7, .7], 7), ([.7, .69, .7, .7], None),
    ([.9, .9, .9, .9, .9], 4), ([], None),
])
def test_gate(spark, values, gate):
    row = monitor.gate(epochs(spark, values)).first()
    assert (row["gate_epoch"] if row else None) == gate


def test_ramp_follows_the_rest_of_the_run(spark):
    got = [r["ramp"] for r in monitor.ramp(epochs(spark, [.9] * 20)).orderBy("epoch").collect()]
    length = max(5, round(.6 * (20 - 3)))
    want = [0.0] * 3 + [min(1.0, (e - 3 + 1) / length) for e in range(3, 20)]
    assert np.allclose(got, want)


def test_metrics_edge_cases(spark):
    rows = [(0, 0, 0, 0), (0, 4, 0, 0), (0, 0, 0, 5), (3, 0, 0, 0), (2, 1, 1, 4)]
    df = spark.createDataFrame(rows, "tp long, fp long, fn long, tn long")
    got = evaluate.derive(df).withColumn("status", evaluate.status()).collect()
    assert [r["status"] for r in got] == [
        "unlabeled", "background only", "background only", "scored", "scored"]
    assert [r["iou"] for r in got] == [None, 0.0, None, 1.0, 0.5]
    assert [r["recall"] for r in got] == [None, None, None, 1.0, 2 / 3]
    assert got[4]["f1"] == 4 / 6 and got[4]["accuracy"] == 6 / 8


def test_softmax_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, -800.0],)], "logits array<double>")
    got = [r["p"] for r in df.select(scoring.softmax("logits").alias("p")).collect()]
    assert got[0] == [0.5, 0.5] and got[1][0] == 1.0


def test_lovasz_equals_its_definition(spark):
    rng = np.random.default_rng(0)
    p, t = rng.random(200).round(2), rng.integers(0, 2, 200)
    rows = [(0, i, 0, int(t[i]), [float(p[i]), float(1 - p[i])]) for i in range(200)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, label int, probs array<double>")
    losses = []
    for c, prob in ((0, p), (1, 1 - p)):
        fg = (t == c).astype(float)
        err = np.abs(fg - prob)
        order = np.argsort(-err, kind="stable")
        hits, count = fg[order].cumsum(), np.arange(1, 201)
        jac = 1 - (fg.sum() - hits) / (fg.sum() + count - hits)
        losses.append((err[order] * np.diff(jac, prepend=0)).sum())
    assert abs(evaluate.lovasz(df).first()["lovasz"] - np.mean(losses)) < 1e-9


def test_blending_a_pixelwise_model_changes_nothing(spark):
    rng = np.random.default_rng(1)
    px = frame(spark, 20, 23, rng.random((20, 23)))
    rows = tiling.assign_patches(px, scene(spark, 20, 23), 8, 3).withColumn(
        "logits", F.array(F.get("norm", 0), -F.get("norm", 0)))
    back = tiling.blend(rows).join(px, ["image_id", "y", "x"])
    assert back.filter(F.abs(F.get("logits", 0) - F.get("norm", 0)) > 1e-12).count() == 0


def test_hash_is_even_and_purposes_are_independent(spark):
    keys = [F.col("id") % 97, F.floor(F.col("id") / 97), F.lit(0)]
    rows = spark.range(20000).select(
        uniform(1, 2, 3, *keys).alias("a"), uniform(1, 2, 4, *keys).alias("b"),
        uniform(1, 3, 3, *keys).alias("c"), mixed(1, 2, 3, *keys).alias("m"))
    row = rows.agg(F.avg("a"), F.avg("b"), F.corr("a", "b"), F.corr("a", "c"),
                   F.countDistinct("m")).first()
    assert abs(row[0] - .5) < .01 and abs(row[1] - .5) < .01
    assert abs(row[2]) < .03 and abs(row[3]) < .03 and row[4] > 19900


def patch_rows(spark, size=8):
    rng = np.random.default_rng(2)
    px = frame(spark, 24, 24, rng.random((24, 24)), bands=3)
    return tiling.assign_patches(px, scene(spark, 24, 24), size, size)


def test_weak_views_permute_pixels(spark):
    rows = patch_rows(spark)
    weak = augment.augment_weak(rows, 8, 1, 1)
    per_patch = weak.groupBy("ty", "tx").agg(
        F.countDistinct("dy", "dx").alias("n"), F.min("dy").alias("a"), F.max("dx").alias("b"))
    assert all((r["n"], r["a"], r["b"]) == (64, 0, 7) for r in per_patch.collect())
    moved = weak.filter("dy <> y - ty or dx <> x - tx").select("ty", "tx").distinct().count()
    assert 0 < moved <= 9
    corner = weak.filter("(y - ty) in (0, 7) and (x - tx) in (0, 7)")
    assert corner.filter("dy not in (0, 7) or dx not in (0, 7)").count() == 0


def test_strong_views_stay_in_range_and_repeat(spark):
    rows = patch_rows(spark)
    plan = augment.strong_plan(tiling.patch_grid(scene(spark, 24, 24), 8, 8), 8, 3, 1, 1)
    strong = augment.augment_strong(rows, plan, 3, 1, 1)
    values = strong.select(F.explode("norm").alias("v"))
    assert values.filter("v < 0 or v > 1").count() == 0
    assert strong.count() == rows.count()
    again = augment.augment_strong(rows.repartition(5), plan, 3, 1, 1)
    assert strong.exceptAll(again).count() == 0
    assert strong.exceptAll(rows.select(*strong.columns)).count() > 0


def test_copy_paste_never_lands_on_excluded_ground(spark):
    px = frame(spark, 32, 32, np.random.default_rng(3).random((32, 32))).withColumn(
        "mask", F.when(F.col("x") < 6, 254).when(F.col("y") % 3 == 0, 0).otherwise(255))
    shape = scene(spark, 32, 32)
    grid = tiling.patch_grid(shape, 8, 4)
    out = augment.compose(grid, px, shape, 8, seed=5, epoch=1, prefer_labeled=True)
    assert out.count() == grid.count() * 64
    own = out.filter("tx + dx < 6 and sx = tx + dx and sy = ty + dy")
    assert own.filter("mask <> 254").count() == 0
    assert out.filter("sy <> ty + dy or sx <> tx + dx").count() > 0


@pytest.fixture(scope="module")
def learnable(spark):
    """Target where the first band is high; two training scenes and a held-out one."""
    rng = np.random.default_rng(9)
    parts = [frame(spark, 20, 20, rng.random((2, 20, 20)), 2, i) for i in range(3)]
    norm = parts[0].unionByName(parts[1]).unionByName(parts[2])
    truth = norm.select("image_id", "y", "x", F.when(F.get("norm", 0) > 0.6, 0).otherwise(1).alias("label"))
    names = [(i, f"s{i}", 20, 20) for i in range(3)]
    shapes = spark.createDataFrame(names, "image_id int, name string, height int, width int")
    roles = spark.createDataFrame(
        [("s0", "training"), ("s1", "training"), ("s2", "validation")], "name string, role string")
    return norm, truth, roles, shapes


def accuracy(model, norm, truth):
    rows = model.apply(norm.filter("image_id = 2")).join(truth, ["image_id", "y", "x"])
    return rows.select(F.avg((F.col("cls") == F.col("label")).cast("double"))).first()[0]


def test_classifier_beats_the_majority_on_a_held_out_scene(learnable):
    norm, truth, roles, shapes = learnable
    model = learn.fit_pixels(norm, truth, roles, shapes)
    majority = truth.filter("image_id = 2").select(F.avg(F.col("label").cast("double"))).first()[0]
    assert accuracy(model, norm, truth) > max(majority, 1 - majority) + 0.1
    with pytest.raises(ValueError, match="No labeled images"):
        learn.fit_pixels(norm, truth.withColumn("label", F.lit(255)), roles, shapes)


def test_self_training_opens_its_gate_and_ramps(learnable):
    norm, truth, roles, shapes = learnable
    sparse = truth.filter("(y + x) % 4 = 0")
    run = learn.self_train(norm, sparse, roles, shapes, rounds=4, threshold=0.6, stable_iou=0.3,
                           patience=2, iterations=20)
    assert [round(e["ramp"], 3) for e in run.log] == [0.0, 0.0, 0.2, 0.4]
    assert accuracy(run.model, norm, truth) > 0.8


def test_neighbourhood_means(spark):
    px = frame(spark, 5, 5, np.arange(25.0).reshape(5, 5))
    row = learn.neighbourhood_means(px).filter("y = 2 and x = 2").first()
    assert row["norm"] == [12.0, 12.0]
    assert learn.neighbourhood_means(px).filter("y = 0 and x = 0").first()["norm"][1] == 3.0


def test_score_patches_checks_shapes_and_predict_checks_sizes(spark, small):
    from contract.fixtures import fixture_model, pixels

    with pytest.raises(ValueError, match="holds no patch of 64"):
        scoring.predict(pixels(spark, small), view(spark, small, "scenes"), fixture_model, 64)
    holed = normed(spark, small).filter("not (y = 3 and x = 3)")
    patches = tiling.to_patches(tiling.assign_patches(holed, view(spark, small, "scenes"), 16, 8))
    with pytest.raises(Exception, match="does not hold 16x16 pixels"):
        scoring.score_patches(patches, fixture_model, 16).count()


def test_gate_counts_an_epoch_once(spark):
    """One good epoch logged three times does not open the gate; the least of its values counts."""
    log = spark.createDataFrame(
        [(1, 1, 9, .9)] * 3 + [(2, e, 9, .9) for e in (3, 1, 2)] + [(2, 2, 9, .1)] + [(3, e, 9, .9) for e in (1, 2, 3)],
        "run_id long, epoch int, epochs int, iou double")
    assert {r["run_id"]: r["gate_epoch"] for r in monitor.gate(log).collect()} == {1: None, 2: None, 3: 4}


def loss_frame(spark):
    """A labelled, an unlabelled and an excluded pixel; the model is sure of each."""
    rows = [(0, 0, 0, 0, 0, [.9, .1], [.8, .2]), (0, 0, 1, 255, 255, [.9, .1], [.7, .3]), (0, 0, 2, 255, 254, [.99, .01], [.1, .9])]
    return spark.createDataFrame(
        rows, "image_id int, y int, x int, label int, mask int, weak_probs array<double>, strong_probs array<double>")


def test_pixels_without_data_enter_no_unsupervised_loss(spark):
    rows = loss_frame(spark)
    assert np.isclose(evaluate.consistency(rows).first()["cons"], .04)
    assert np.isclose(evaluate.pseudo_ce(rows, threshold=.8).first()["pseudo"], -np.log(.7))
    guessed = evaluate.pseudo_labels(rows.withColumn("probs", F.col("weak_probs")), .8).collect()
    assert [(r["x"], r["pseudo"]) for r in guessed] == [(1, 0)]


def test_lovasz_of_a_confident_model_is_spread(spark):
    """Errors within 2e-4 still fall into many buckets, and the loss is that of one sort."""
    rng = np.random.default_rng(1)
    n = 3000
    label, err = rng.integers(0, 2, n), rng.random(n) * 2e-4
    rows = [(0, int(t), [float(1 - e), float(e)] if t == 0 else [float(e), float(1 - e)]) for t, e in zip(label, err)]
    got = evaluate.lovasz(spark.createDataFrame(rows, "image_id int, label int, probs array<double>")).first()["lovasz"]
    want = []
    for c in (0, 1):
        order = np.argsort(-err, kind="stable")
        fg = (label == c)[order]
        j = 1 - (fg.sum() - np.cumsum(fg)) / (fg.sum() + np.arange(1, n + 1) - np.cumsum(fg))
        want.append((err[order] * np.diff(np.concatenate([[0], j]))).sum())
    assert np.isclose(got, np.mean(want), rtol=1e-6, atol=0)


def test_window_counts_need_no_dense_masks(spark):
    """A labelled 4 by 4 block with nothing around it counts as 16 in any window that holds it."""
    masks = spark.createDataFrame([(0, y, x, int(y == x)) for y in range(2, 6) for x in range(2, 6)], "image_id int, y int, x int, mask int")
    scenes = spark.createDataFrame([(0, 10, 12)], "image_id int, height int, width int")
    windows = spark.createDataFrame([(0, 0, 0), (0, 2, 4), (0, 0, 5)], "image_id int, oy int, ox int")
    got = augment.window_label_stats(windows, augment.label_integral(masks, scenes), 7).collect()
    assert {(r["oy"], r["ox"]): (r["labeled_px"], r["target_px"]) for r in got} == {(0, 0): (16, 12), (2, 4): (8, 6), (0, 5): (4, 3)}


def live_gates(spark, folder, files, **options):
    """Gates of an epoch log that arrives in these files, one per micro-batch."""
    schema = "run_id long, epoch int, iou double"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    # File streams take files by time of writing.
    log = spark.readStream.schema(schema + ", part int").option(
        "maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = live.stream_gate(log, **options).writeStream.outputMode("append").format("parquet").option(
        "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start()
    run.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("run_id long, gate_epoch int").parquet(
        f"{folder}/out").collect())


def test_live_gate_takes_epochs_in_any_order(spark, tmp_path):
    """Late epochs close gaps, the first of a repeated epoch counts, a gate opens once."""
    files = [
        [(1, 5, .9), (1, 3, .9), (2, 1, .9), (2, 2, .1), (3, 1, .8), (3, 1, .2), (4, 9, None)],
        [(1, 9, .2), (2, 2, .9), (2, 3, .9), (3, 2, .9), (3, 3, .9), (None, 1, .9), (4, None, .9)],
        [(1, 4, .7), (2, 4, .9), (3, 4, .9), (4, 7, .9), (4, 8, .9)],
        [(1, 6, .9), (1, 2, .9), (2, 5, .9), (4, 10, .9), (4, 6, .9)],
    ]
    assert live_gates(spark, tmp_path, files, patience=3) == [(1, 6), (2, 6), (3, 5), (4, 9)]


def test_live_gate_equals_the_batch_gate_within_its_horizon(spark, tmp_path):
    """Rising epochs in three micro-batches; a late epoch beyond the horizon counts no more."""
    rng = np.random.default_rng(2)
    rows = [(run, e, float(rng.choice([.6, .8], p=[.3, .7]))) for run in range(30) for e in range(1, 9)]
    frame = spark.createDataFrame(
        [(r, e, 8, v) for r, e, v in rows], "run_id long, epoch int, epochs int, iou double")
    want = sorted((r["run_id"], r["gate_epoch"]) for r in monitor.gate(frame).collect() if r["gate_epoch"])
    files = [[r for r in rows if r[1] in part] for part in ((1, 2), (3, 4, 5), (6, 7, 8))]
    files[0] += [(99, 1, .8), (99, 2, .8)]
    files[1] += [(99, 20, .1)]
    files[2] += [(99, 3, .8)]
    assert live_gates(spark, tmp_path, files, horizon=10) == want and len(want) > 5


class CountedState:
    """State of one run in memory, counting calls to the store."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def _called(self):
        self.calls += 1
        return self

    def getMapState(self, *_):
        return CountedState._Map(self)

    def getValueState(self, name, _):
        return CountedState._Value(self, name)

    class _Map:
        def __init__(self, store):
            self.store, self.rows = store, {}

        def getValue(self, key):
            return self.store._called() and self.rows.get(key)

        def containsKey(self, key):
            return self.store._called() and key in self.rows

        def updateValue(self, key, value):
            self.store._called()
            self.rows[key] = value

        def clear(self):
            self.rows.clear()

    class _Value:
        def __init__(self, store, name):
            self.store, self.name = store, name

        def exists(self):
            return self.store._called() and self.name in self.store.kept

        def update(self, value):
            self.store._called().kept[self.name] = value

        def clear(self):
            self.store.kept.pop(self.name, None)


def test_live_gate_calls_its_store_per_entry_not_per_epoch():
    store = CountedState()
    gate = live.Gate(.7, 3, None)
    gate.init(store)
    opened = []
    for epochs in (range(500, 1000), range(-500, 500), range(1000, 1500), [1500, 1501, 1502]):
        iou = [.9 if e % 3 or e > 1499 else .1 for e in epochs]
        frame = pd.DataFrame({"run_id": 7, "epoch": list(epochs), "iou": iou})
        opened += [out["gate_epoch"].tolist() for out in gate.handleInputRows((7,), iter([frame]), None)]
    assert opened == [[1501]] and store.calls < 30


def test_scoring_cuts_and_flattens_no_arrays_in_the_plan(spark, small):
    from contract.fixtures import fixture_model

    patches = tiling.to_patches(tiling.assign_patches(normed(spark, small), view(spark, small, "scenes"), 16, 8))
    scored = scoring.score_patches(patches, fixture_model, 16, batch=5)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "flatten(" not in plan
    assert scored.count() == patches.count() * 256


def test_only_pasted_pixels_go_through_the_second_join(spark):
    """Pixels without a donor would all meet at the null key of their scene."""
    plan = spark.createDataFrame([(0, 0, 0, None, False, False, False)], "image_id int, ty int, tx int, "
                                 "donor5 struct<oy: int, ox: int>, paste boolean, paste_h boolean, paste_v boolean")
    px = spark.createDataFrame([(0, y, x, [.5], 1) for y in range(2) for x in range(2)],
                               "image_id int, y int, x int, norm array<double>, mask int")
    out = augment.render(plan, px, 2)
    assert "Union" in out._jdf.queryExecution().analyzed().toString() and out.count() == 4
