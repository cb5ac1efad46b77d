import math
import random

import numpy as np
import pytest
from geometry import scene
from pyspark.sql import functions as F

from contract.fixtures import view
from pixelframe.operators import evaluate, labels, undo
from pixelframe.operators.undo import match_undo, replay_with_undo
from pixelframe.schema import EDITS
from pixelframe.streaming import edits as stream
from pixelframe.streaming import state

HEIGHT = WIDTH = 12


def step_by_step(log, limit, drawn=None):
    """The editor, one edit at a time; `drawn` holds the pixels of edits that are no stamps."""
    state, stack = {}, []
    for seq, kind, value, cx, cy, r in log:
        if kind == "undo":
            if stack:
                state.update(stack.pop())
            continue
        diff = {}
        if kind == "clear":
            touched = [p for p, v in state.items() if v != 255]
            value = 255
        elif kind == "drawn":
            touched = drawn[seq]
        else:
            touched = [
                (y, x) for y in range(HEIGHT) for x in range(WIDTH)
                if (x - cx) ** 2 + (y - cy) ** 2 <= r * r
            ]
        for p in touched:
            if state.get(p, 255) != value:
                diff[p] = state.get(p, 255)
                state[p] = value
        if diff:
            stack.append(diff)
            del stack[:-limit]
    return {p: v for p, v in state.items() if v != 255}


def random_log(seed, length, undo_share):
    rng = random.Random(seed)
    log = []
    for seq in range(length):
        roll = rng.random()
        kind = "undo" if roll < undo_share else "clear" if roll < undo_share + 0.08 else "stamp"
        log.append((seq, kind, rng.choice([0, 1, 255]), rng.uniform(0, 12), rng.uniform(0, 12),
                    float(rng.choice([1, 2]))))
    return log


def frame_of(spark, log):
    return spark.createDataFrame(
        [(s, None, 0, k, v, cx, cy, r) for s, k, v, cx, cy, r in log], EDITS
    )


@pytest.mark.parametrize("seed,undo_share,limit", [(1, 0.3, 50), (2, 0.45, 3)])
def test_undo_equals_step_by_step(spark, seed, undo_share, limit):
    log = random_log(seed, 60, undo_share)
    got = replay_with_undo(frame_of(spark, log), scene(spark, HEIGHT, WIDTH), limit)
    assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == step_by_step(log, limit)


def chain(links):
    """Each link: paint, paint the same again for nothing, undo; whether a paint counts hangs on the link before."""
    kinds = ["stamp", "stamp", "undo"] * links
    return [(i, kind, 0, 5.0, 5.0, 2.0) for i, kind in enumerate(kinds)]


@pytest.mark.parametrize("log", [chain(30), random_log(5, 90, 0.5) + [(200, "stamp", 1, 3.0, 3.0, 2.0)]])
def test_rounds_of_undo_are_bounded(spark, log):
    rounds = []
    got = replay_with_undo(frame_of(spark, log), scene(spark, HEIGHT, WIDTH), 50, each_round=rounds.append)
    assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == step_by_step(log, 50)
    assert len(rounds) <= undo.ROUNDS


def test_undo_over_every_kind_of_edit(spark):
    """Strokes, polygons and a selection among stamps, over several blocks."""
    rng = random.Random(11)
    log = random_log(8, 60, 0.35)
    kinds = {i: rng.choice(["stroke", "polygon", "selection"]) for i in range(0, 60, 4)}
    log = [(s, "drawn" if s in kinds else k, v, cx, cy, r) for s, k, v, cx, cy, r in log]
    value = {s: v for s, _, v, *_ in log}
    of = lambda kind: [s for s in kinds if kinds[s] == kind]
    shape = scene(spark, HEIGHT, WIDTH)
    corners = lambda s: [(rng.uniform(-2, 14), rng.uniform(-2, 14)) for _ in range(4)]
    strokes = spark.createDataFrame(
        [(0, s, i, x, y, 1.5, s, value[s]) for s in of("stroke") for i, (x, y) in enumerate(corners(s))],
        "image_id int, stroke_id int, pos int, cx double, cy double, r double, seq long, value int")
    polygons = spark.createDataFrame(
        [(0, s, i, x, y) for s in of("polygon") for i, (x, y) in enumerate(corners(s))],
        "image_id int, poly_id int, vertex int, vx double, vy double")
    picked = spark.createDataFrame(
        [(0, rng.randrange(12), rng.randrange(12), s, value[s]) for s in of("selection") for _ in range(30)],
        "image_id int, y int, x int, seq long, value int")
    values = spark.createDataFrame(list(value.items()), "seq long, value int")
    filled = labels.polygon_runs(polygons, shape).withColumn("seq", F.col("poly_id").cast("long")).join(values, "seq")
    runs = labels.stroke_runs(strokes, shape).unionByName(labels.pixel_runs(picked)).unionByName(
        filled.select(*labels.RUN))

    drawn = {s: set() for s in kinds}
    for r in picked.collect():
        drawn[r["seq"]].add((r["y"], r["x"]))
    for r in labels.fill_polygons(polygons, shape).collect():
        drawn[r["poly_id"]].add((r["y"], r["x"]))
    marks = labels.stroke_points(strokes).drop("cx", "cy").withColumnsRenamed({"sx": "cx", "sy": "cy"})
    for r in labels.stamp(marks, shape).collect():
        drawn[r["seq"]].add((r["y"], r["x"]))

    got = replay_with_undo(frame_of(spark, log), shape, 50, runs)
    assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == step_by_step(log, 50, drawn)


def test_runs_hold_the_pixels_of_discs(spark, small):
    edits = view(spark, small, "edits").filter("kind = 'stamp'")
    shapes = view(spark, small, "scenes")
    runs = labels.stamp_runs(edits, shapes).withColumn("x", F.explode(F.sequence("x0", "x1"))).select(
        "image_id", "y", "x", "seq", "value")
    discs = labels.stamp(edits, shapes).select("image_id", "y", "x", "seq", "value")
    assert runs.exceptAll(discs).count() == discs.exceptAll(runs).count() == 0 < discs.count()


def test_stack_sums_compose():
    """A chunk's sum does to any stack what its steps do one by one."""
    rng = random.Random(3)
    for limit in (1, 3, 50):
        for _ in range(200):
            pushes = np.array([rng.choice([1, -1, -1]) for _ in range(rng.randrange(12))], dtype=int)
            seqs = np.arange(100, 100 + len(pushes))
            below = list(range(rng.randrange(limit + 1)))
            taken, room, own = undo._summed_up(seqs, pushes, limit)
            left = max(0, len(below) - taken)
            stack = below[max(0, left - max(0, room)):left] + own
            walked = list(below)
            undo._walked(walked, seqs, pushes, limit)
            assert stack == walked


def test_undo_pairs(spark):
    #        empty undo, then nested pairs with a stack of two
    moves = [-1, 1, 1, 1, -1, -1, -1, 1, -1]
    steps = spark.createDataFrame(
        [(0, i, m) for i, m in enumerate(moves)], "image_id int, seq long, push int")
    pairs = {r["seq"]: r["undone_at"] for r in match_undo(steps, 2).collect()}
    assert pairs == {3: 4, 2: 5, 7: 8}


def test_replay_and_diff_agree(spark):
    log = [e for e in random_log(3, 80, 0.0)]
    edits, shape = frame_of(spark, log), scene(spark, HEIGHT, WIDTH)
    final = labels.replay(labels.pixel_edits(edits, shape), edits.filter("kind = 'clear'"))
    want = step_by_step(log, 50)
    assert {(r["y"], r["x"]): r["label"] for r in final.collect()} == want
    diff = labels.edit_diff(edits, shape)
    assert diff.filter("prev = value").count() == 0
    last = diff.groupBy("y", "x").agg(F.max_by("value", "seq").alias("v")).filter("v <> 255")
    assert {(r["y"], r["x"]): r["v"] for r in last.collect()} == want


def test_square_polygon(spark):
    corners = [(10.25, 5.25), (20.25, 5.25), (20.25, 12.25), (10.25, 12.25)]
    rows = [(1, i, 0, x, y) for i, (x, y) in enumerate(corners)] + [(2, 0, 0, 1.0, 1.0), (2, 1, 0, 5.0, 5.0)]
    polys = spark.createDataFrame(rows, "poly_id int, vertex int, image_id int, vx double, vy double")
    got = {(r["y"], r["x"]) for r in labels.fill_polygons(polys, scene(spark, 30, 50)).collect()}
    assert got == {(y, x) for y in range(5, 12) for x in range(10, 20)}


def test_stroke_spacing(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 2.0), (1, 1, 0, 3.0, 4.0, 2.0)]
    strokes = spark.createDataFrame(
        rows, "stroke_id int, pos int, image_id int, cx double, cy double, r double")
    got = labels.stroke_points(strokes).collect()
    assert sorted((r["pos"], r["step"], round(r["sx"], 6)) for r in got) == [
        (0, 1, 0.0), *[(1, i, round(3.0 * i / 5, 6)) for i in range(1, 6)]]


def test_repair_keeps_rich_labels_and_drops_the_rest(spark):
    values = [0.0, 7.0, 254.0, 255.0, 300.0, -9999.0, float("nan"), float("inf"), 1.9, None]
    df = spark.createDataFrame([(v,) for v in values], "raw_label double")
    assert [r["label"] for r in labels.repair_mask(df).collect()] == [
        0, 7, 255, 255, 255, 255, 255, 255, 1, 255]


def test_stream_is_order_and_repeat_proof(spark, tmp_path):
    log = random_log(5, 90, 0.0)
    edits, shape = frame_of(spark, log), scene(spark, HEIGHT, WIDTH)
    parts = [edits.filter(F.col("seq") % 3 == k) for k in (2, 0, 1)]
    for part in [*parts, parts[0]]:  # out of order, and one file twice
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EDITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.stream_labels(source, shape, str(tmp_path / "state"), str(tmp_path / "log"))
    run.awaitTermination()
    want = labels.replay(labels.pixel_edits(edits, shape), edits.filter("kind = 'clear'"))
    key = lambda df: sorted((r["y"], r["x"], r["label"], r["seq"]) for r in df.collect())
    assert key(state.read_state(spark, str(tmp_path / "state"))) == key(want)
    state.copy_state(spark, str(tmp_path / "state"), str(tmp_path / "small"), buckets=3)
    assert key(state.read_state(spark, str(tmp_path / "small"))) == key(want)


def wide_log(seed, length):
    """Edits all over a scene of several blocks, with clears, and a second scene without."""
    rng = random.Random(seed)
    rows = []
    for seq in range(length):
        kind = "clear" if rng.random() < 0.04 else "stamp"
        scene_id = rng.choice([0, 0, 1])
        rows.append((seq, None, scene_id, "stamp" if scene_id else kind, rng.choice([0, 1, 255]),
                     rng.uniform(0, 200), rng.uniform(0, 200), float(rng.choice([1, 3, 9]))))
    return rows


def test_live_counts_equal_the_batch_after_every_batch(spark, tmp_path):
    log, path = wide_log(21, 160), str(tmp_path / "state")
    edits = spark.createDataFrame(log, EDITS)
    shape = spark.createDataFrame([(0, 200, 200), (1, 200, 200)], "image_id int, height int, width int")
    grid = spark.range(2 * 200 * 200).select(
        F.floor(F.col("id") / 40000).cast("int").alias("image_id"), (F.floor(F.col("id") / 200) % 200).cast("int").alias("y"),
        (F.col("id") % 200).cast("int").alias("x"))
    pred = grid.withColumn("cls", (F.hash("y", "x") % 2 == 0).cast("int")).withColumn("valid", F.col("x") % 11 != 3)
    order = list(range(160))
    random.Random(4).shuffle(order)  # late edits
    seen = []
    for version, part in enumerate([order[:50], order[50:90], order[30:70], order[90:], order[:5]]):
        seen += part
        state.fold(edits.filter(F.col("seq").isin(part)), version, shape, path, pred, buckets=8)
        so_far = edits.filter(F.col("seq").isin(seen))
        want = labels.replay(labels.pixel_edits(so_far, shape), so_far.filter("kind = 'clear'"))
        assert {tuple(r) for r in state.read_state(spark, path).collect()} == {tuple(r) for r in want.collect()}
        joined = want.join(pred, ["image_id", "y", "x"])
        counts = {tuple(r) for r in evaluate.confusion(joined).collect() if sum(r[1:])}
        live = {r["image_id"]: r["iou"] for r in state.read_live(spark, path).collect()}
        assert {tuple(r)[:5] for r in state.read_live(spark, path).collect()} == counts
        ious = {r["image_id"]: r["iou"] for r in evaluate.target_iou(joined).collect()}
        assert all(live[i] == ious[i] for i in live)


def test_state_rewrites_only_what_a_batch_touches(spark, tmp_path):
    path = str(tmp_path / "state")
    shape = spark.createDataFrame([(0, 1000, 1000)], "image_id int, height int, width int")
    stamp = lambda seq, x, value=0: (seq, None, 0, "stamp", value, float(x), 500.0, 2.0)
    batch = lambda *rows: spark.createDataFrame(list(rows), EDITS)
    state.fold(batch(*[stamp(i, 30 + 64 * i) for i in range(15)]), 0, shape, path)
    first = state.manifest_of(spark, path)
    state.fold(batch(stamp(20, 30, 1)), 1, shape, path)
    second = state.manifest_of(spark, path)
    assert sum(second.buckets[b] != first.buckets[b] for b in first.buckets) == 1 and len(first.buckets) > 5

    rows = lambda: sorted(tuple(r) for r in state.read_state(spark, path).collect())
    before = rows()
    # A batch that died before its manifest leaves the state as it was; run again it counts once.
    spark.createDataFrame([(0, 1, 1, 99, 0, 255, 0)], state.ROWS + ", bucket int").write.partitionBy("bucket").parquet(
        f"{path}/data/version=2")
    assert rows() == before
    for _ in range(2):
        state.fold(batch(stamp(30, 94, 1), stamp(3, 94, 1)), 2, shape, path)
        assert {r[3:] for r in rows() if r[2] == 94} == {(1, 30)} and len(rows()) == len(before)
    # What neither of the last two manifests names is gone, however many batches there were.
    for version in range(3, 9):
        state.fold(batch(stamp(40 + version, 30, version % 2)), version, shape, path)
    assert state.complete_versions(spark, path) == [7, 8]
    named = {v for n in (8, 9) for v in state.manifest_of(spark, path, n).buckets.values()}
    assert {int(f.name.split("=")[1]) for f in (tmp_path / "state" / "data").iterdir()} == named


def test_streamed_rates_and_saves_equal_batch(spark, small, tmp_path):
    from contract.fixtures import view
    from pixelframe.operators import monitor

    edits = view(spark, small, "edits").withColumn("ts", F.col("ts").cast("timestamp"))
    end = edits.agg(F.max("ts") + F.expr("interval 30 days")).first()[0]
    tail = edits.limit(1).withColumn("ts", F.lit(end)).withColumn("image_id", F.lit(-1))
    edits.unionByName(tail).coalesce(1).write.parquet(str(tmp_path / "in"))
    flow = spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in"))
    stream.stream_save_points(
        flow, str(tmp_path / "s"), str(tmp_path / "sc"), "10 minutes").awaitTermination()
    stream.stream_label_rate(
        flow, str(tmp_path / "r"), str(tmp_path / "rc"), "1 hour").awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.filter("image_id >= 0").collect())
    assert rows(spark.read.parquet(str(tmp_path / "s"))) == rows(monitor.save_points(edits, "10 minutes"))
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == rows(monitor.label_rate(edits, "1 hour"))


def test_undo_reads_a_block_batch_by_batch():
    """The log of a block is never held whole: results come while it is read, wherever batches end."""
    import pandas as pd

    rows = []
    for seq in range(40):
        undone_at = 1000 if seq == 39 else undo.NEVER
        rows += [(1, 0, 0, seq, False, seq, seq % 2, y, 0, seq % 7, True, undone_at) for y in range(2)]
    rows.append((1, 0, 0, 1000, True, 39, None, None, None, None, True, 1000))
    names = [*undo.STEP, "seq", "value", "y", "x0", "x1", "live", "undone_at"]
    log = pd.DataFrame(rows, columns=names)
    results = []
    for size in (1, 3, len(log)):
        read = []

        def frames():
            for at in range(0, len(log), size):
                read.append(at)
                yield log.iloc[at:at + size].reset_index(drop=True)

        last = pd.concat(undo._stepper(True)(frames()))
        read.clear()
        judged = undo._stepper(False)(frames())
        next(judged)
        assert len(read) <= 2 + 2 // size
        results.append((last.values.tolist(), len(last)))
    assert results[0] == results[1] == results[2]
    assert max(row[4] for row in results[0][0]) == 38 and results[0][1] == 14


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_diff_equals_step_by_step_over_chunks(spark, monkeypatch, chunk):
    """Eras that lie in a chunk, reach over chunks or never end; only pixels that cross a chunk's border are shuffled."""
    monkeypatch.setattr(labels, "EDIT_CHUNK", chunk)
    log = random_log(4, 60, 0.0)
    state, want = {}, []
    for seq, kind, value, cx, cy, r in log:
        drawn = [(y, x) for y in range(HEIGHT) for x in range(WIDTH) if (x - cx) ** 2 + (y - cy) ** 2 <= r * r]
        for p in list(state) if kind == "clear" else drawn:
            now = 255 if kind == "clear" else value
            if state.get(p, 255) != now:
                want.append((0, *p, seq, state.get(p, 255), now))
            state[p] = now
    edits, shape = frame_of(spark, log), scene(spark, HEIGHT, WIDTH)
    diff = labels.edit_diff(edits, shape).select("image_id", "y", "x", "seq", "prev", "value")
    assert sorted(tuple(r) for r in diff.collect()) == sorted(want) and len(want) > 200
    clears = {seq for seq, kind, *_ in log if kind == "clear"}
    wiped = labels.wiped_pixels(edits, shape).select("image_id", "y", "x", "seq", "prev", "value").collect()
    assert sorted(tuple(r) for r in wiped) == sorted(w for w in want if w[3] in clears)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert len([line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange hash" in line and " y#" in line]) == 1


def test_crossings_are_paired_where_they_are_sorted(spark, small):
    """No table of pairs is built in a task beside its sorted crossings."""
    runs = labels.polygon_runs(view(spark, small, "polygons"), view(spark, small, "scenes"))
    above = runs._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert "Aggregate" not in above and runs.count() > 0
