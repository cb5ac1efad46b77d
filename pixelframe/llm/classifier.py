"""A quality classifier by naive Bayes support vectors.

A text is the set of its byte n-grams (two and three bytes, hashed), with a few indicators of length
and of repeated words. Indicators are scaled by the log ratio of their smoothed shares in the two
classes, counted over all labelled rows; a linear model with hinge loss is then fitted by dual
coordinate descent on a bounded sample of labelled rows, and its margins are turned to probabilities
by a logistic curve. All documents are scored where they are scanned.

Rows whose crc32(doc_id as text) leaves 0 modulo 5 never serve learning. Null text is empty.
A doc_id with several labels counts by the least. Without labels of both classes every score is the
share of label 1 among those there are (a half without any).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import documents, table
from pixelframe.session import cut

SAMPLE = 12_000  # labelled rows that the linear model is fitted on, about
THRESHOLD = 0.3
PAIRS, TRIPLES, EXTRAS = 1 << 14, 1 << 15, 64  # places of hashed two-grams, three-grams, further indicators
DIMS = PAIRS + TRIPLES + EXTRAS
EPOCHS, COST, SMOOTH = 20, 1.0, 1.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(text: bytes | None, flags: np.ndarray) -> np.ndarray:
    """The places of a text's indicators. `flags` is scratch of DIMS falses."""
    data = np.frombuffer(text or b"", np.uint8).astype(np.uint32)
    if len(data) > 1:
        two = data[:-1] * np.uint32(256) + data[1:]
        flags[(two * np.uint32(0x9E3779B1)) >> np.uint32(18)] = True
        three = (two[:-1] * np.uint32(256) + data[2:]) * np.uint32(0x85EBCA6B)
        flags[((three ^ (three >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(17)) + PAIRS] = True
    words = (text or b"").split()
    extras = PAIRS + TRIPLES
    flags[extras + min(15, len(words).bit_length())] = True
    same = sum(a == b for a, b in zip(words, words[1:]))
    flags[extras + 16 + min(15, 32 * same // max(1, len(words)))] = True
    flags[extras + 32 + min(15, 16 * len(set(words)) // max(1, len(words)))] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


LEARNT = "place int, c0 long, c1 long, y int, found binary"


def learner(share: float):
    """Labelled rows (doc_id, text, y) to counts of each place by class, and a sample's places."""

    def learn(batches):
        flags, counts, seen = np.zeros(DIMS, bool), np.zeros((2, DIMS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            rows = []
            for text, y, draw in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "draw"))):
                found = features(text, flags)
                counts[y, found] += 1
                seen[y] += 1
                if draw < share:
                    rows.append((y, found.astype("<u4").tobytes()))
            if rows:
                y, found = zip(*rows)
                none = pa.nulls(len(rows), pa.int32())
                yield pa.record_batch([none, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(y, pa.int32()), pa.array(found, pa.binary())], names=["place", "c0", "c1", "y", "found"])
        at = np.flatnonzero(counts.any(axis=0))
        at, c0, c1 = np.append(at, -1), np.append(counts[0, at], seen[0]), np.append(counts[1, at], seen[1])
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(c0), pa.array(c1), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=["place", "c0", "c1", "y", "found"])

    return learn


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights on the scaled indicators and bias, by dual coordinate descent for squared-norm, hinge loss."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norms = [float(v @ v) + 1.0 for v in values]
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through margins, by Newton steps, slightly damped."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, s = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin + 1e-3 * a, g.sum() + 1e-3 * b])
        hess = np.array([[s @ (margin * margin) + 1e-3, s @ margin], [s @ margin, s.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fitter(ratio: np.ndarray):
    """A sample's places (y, found) to the model: weights by place, bias, slope, intercept."""

    def fit(batches):
        rows, y = [], []
        for batch in batches:
            y += batch.column("y").to_pylist()
            rows += [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.column("found").to_pylist()]
        if not rows:
            return
        order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes()))  # the same on every run
        rows, y = [rows[i] for i in order], np.array(y)[order]
        w, bias = descend(rows, 2.0 * y - 1, ratio)
        weights = w * ratio
        margin = np.array([weights[r].sum() / np.sqrt(max(1, len(r))) + bias for r in rows])
        model = np.concatenate([weights, [bias, *logistic(margin, y.astype(float))]])
        yield pa.record_batch([pa.array([model.tobytes()], pa.binary())], names=["model"])

    return fit


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The model: DIMS weights, bias, slope and intercept of the logistic curve."""
    known = (
        labels.where("quality is not null and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    )
    n = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = (
        docs.where(~held_out()).select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(known.hint("merge"), "doc_id").select("text", "y", draw.alias("draw"))  # one plan at every size
    )
    learnt = cut(rows.mapInArrow(learner(sample / max(n, 1)), LEARNT))
    # A row for each place at most, whatever the input.
    sums = learnt.where("place is not null").groupBy("place").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).collect()
    counts, total = np.zeros((2, DIMS)), np.zeros(2)
    for r in sums:
        if r.place < 0:
            total[:] = r.c0, r.c1
        else:
            counts[:, r.place] = r.c0, r.c1
    if not total.all():
        share = total[1] / total.sum() if total.sum() else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.concatenate([np.zeros(DIMS), [0.0, 1.0, np.log(share / (1 - share))]])
    smooth = counts + SMOOTH
    p = smooth / smooth.sum(axis=1, keepdims=True)
    ratio = np.log(p[1] / p[0])
    fitted = learnt.where("y is not null").select("y", "found").repartition(1).mapInArrow(fitter(ratio), "model binary").collect()
    return np.frombuffer(bytes(fitted[0].model))


def scorer(shared):
    def score(batches):
        model, flags = shared.value, np.zeros(DIMS, bool)
        weights, (bias, slope, intercept) = model[:DIMS], model[DIMS:]
        for batch in batches:
            margins = []
            for text in batch.column("text").to_pylist():
                found = features(text, flags)
                margins.append(weights[found].sum() / np.sqrt(max(1, len(found))) + bias)
            scores = 1 / (1 + np.exp(-np.clip(slope * np.array(margins, float) + intercept, -500, 500)))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.record_batch([*rest, pa.array(scores)], names=[*(x for x in batch.schema.names if x != "text"), "score"])

    return score


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # DIMS + 3 numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    scored = rows.mapInArrow(scorer(shared), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, all columns kept.

    A doc_id goes if any of its rows is rejected; rows without a doc_id stay.
    """
    bad = scores(docs, labels, threshold).where("predicted = 0").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("_bad"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
