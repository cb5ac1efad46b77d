"""Near-duplicate groups by SuperMinHash.

A document is the set of its distinct five-word shingles. Equal sets form one class. Each class gets
a SuperMinHash signature: every element draws, step by step, a rank from a random permutation of the
signature's places, so values of one element are correlated and the estimate varies less than with
independent minima; an element stops as soon as no place can still improve. Bands of the signature
bring similar classes together. In each bucket all classes are compared with the smallest, links are
confirmed on the full sets, and union-find groups them. In buckets that still hold several groups,
the members outside the largest group are queries against the whole bucket, taken in blocks of
bounded size, so that a link between two members is found even if neither is linked with the
bucket's smallest; of a query's links with one group, one is told.

Null or wordless text: empty set, linked with nothing. Rows without a doc_id are linked with nothing
and have no component. Rows that share a doc_id are one document with the links of either.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.bytehash import BASE, MASK, Rolling, joined, mix
from pixelframe.llm.components import components
from pixelframe.llm.common import documents, salted_join
from pixelframe.session import cut

WORDS = 5  # of a shingle
PERCENT = 85  # least similarity of a link
PLACES, ROWS = 64, 4  # of a signature, and of a band: a link at 0.85 is missed with 7e-6
PAIR_BITS = 40  # random bits of a rank's fraction
BLOCK = 256  # members of a bucket that queries are compared with at once, about
BATCH = 4 << 20  # bytes of text hashed at once


def blocks(batch: pa.RecordBatch, size: int = BATCH):
    """Slices of a record batch of about `size` bytes of text (one row at least)."""
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (binary, null: empty)."""
    data, offsets = joined(column, b" ")
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(column)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    blank = (lower == 32) | ((lower >= 9) & (lower <= 13))
    edge = np.diff(np.concatenate([[1], blank.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = Rolling(lower).spans(starts, ends) + (ends - starts).astype(np.uint64)
    bounds = np.searchsorted(starts, offsets)  # first word of each text
    factors = mix(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    whole = sum((padded[k:k + len(word)] * factors[k] for k in range(WORDS)), np.zeros(len(word), np.uint64))
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(whole[a:b - WORDS + 1]))
        elif b > a:
            short = (word[a:b] * factors[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """A SuperMinHash signature (len(sets) x places) of each set; all sets advance a step at a time."""
    n = len(sets)
    sig = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    perm = None  # of the items still in play; at step 0 each is the identity
    for j in range(places):
        draw = mix(items + np.uint64(BASE * (j + 1) & MASK))
        k = (draw >> np.uint64(PAIR_BITS)) % np.uint64(places - j) + np.uint64(j)
        rank = (np.uint64(j) << np.uint64(PAIR_BITS)) | (draw & np.uint64((1 << PAIR_BITS) - 1))
        if j == 0:
            place = k.astype(np.int64)
        else:
            row, k = np.arange(len(items)), k.astype(np.int64)
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
            perm[row, j] = place
        np.minimum.at(sig, owner * places + place, rank)
        # An item stops where every place of its set holds a rank below the next step's least.
        open_sets = sig.reshape(n, places).max(axis=1) >= np.uint64(j + 1) << np.uint64(PAIR_BITS)
        alive = open_sets[owner]
        if not alive.any():
            break
        if j == 0:
            first = place[alive]
            perm = np.tile(np.arange(places, dtype=np.uint16), (int(alive.sum()), 1))
            row = np.arange(len(first))
            perm[row, 0], perm[row, first] = first, 0
            perm[row[first == 0], 0] = 0
        else:
            perm = perm[alive]
        items, owner = items[alive], owner[alive]
    return sig.reshape(n, places)


def signed(batches):
    """(doc_id, n, fp1, fp2, bands) of documents (doc_id, text as binary)."""
    for whole in batches:
        for batch in blocks(whole):
            sets = shingle_sets(batch.column("text"))
            sig = signatures(sets)
            salt = mix(np.arange(PLACES, dtype=np.uint64) + np.uint64(99)) | np.uint64(1)
            parts = (mix(sig) * salt).reshape(len(sets), PLACES // ROWS, ROWS)
            bands = mix(parts.sum(axis=2, dtype=np.uint64)).view(np.int64)
            fp = [np.array([mix(s * np.uint64(m)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for m in (3, BASE)]
            empty = [len(s) == 0 for s in sets]
            lists = lambda x: pa.array([None if e else r for e, r in zip(empty, x.tolist())], pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp[0]), pa.array(fp[1]), lists(bands)],
                names=["doc_id", "n", "fp1", "fp2", "bands"],
            )


def whole_sets(batches):
    """(doc_id, items) of documents (doc_id, text as binary)."""
    for whole in batches:
        for batch in blocks(whole):
            sets = shingle_sets(batch.column("text"))
            items = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), items], names=["doc_id", "items"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of `pairs` (a, b) those whose full sets reach the similarity."""
    own = lambda side: sets.select(F.col("doc_id").alias(side), F.col("items").alias(f"{side}_items"))
    both = pairs.join(own("b"), "b").join(own("a"), "a")
    shared = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - shared
    return both.where(100 * shared >= percent * union).select("a", "b")


def compare(percent: int):
    """A block of members and its queries (rep, root, asks, items) to links (a, b) between different groups."""

    def links(rows: pa.Table) -> pa.Table:
        found = set()
        queries, members = rows.filter(rows.column("asks")), rows.filter(pc.invert(rows.column("asks")))
        if queries.num_rows and members.num_rows:
            sets = [np.asarray(x.values) for x in members.column("items")]
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            items = np.concatenate(sets)
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            sizes = np.array([len(x) for x in sets])
            reps, roots = np.asarray(members.column("rep")), np.asarray(members.column("root"))
            for rep, root, values in zip(queries.column("rep").to_pylist(), queries.column("root").to_pylist(), queries.column("items")):
                own = np.asarray(values.values)
                lo, hi = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(sets))
                linked = (100 * shared >= percent * (len(own) + sizes - shared)) & (roots != root)
                _, first = np.unique(roots[linked], return_index=True)
                found |= {(min(rep, r), max(rep, r)) for r in reps[linked][first].tolist()}
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


def links_across(held: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of a bucket (band, key, rep) whose groups differ so far."""
    grouped = cut(
        held.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("band", "key", "rep", F.coalesce("root", "rep").alias("root"))
    )
    groups = grouped.groupBy("band", "key", "root").count().groupBy("band", "key").agg(
        F.max(F.struct("count", "root")).alias("most"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("n_roots"))
    mixed = groups.where("n_roots > 1").select("band", "key", F.col("most.root").alias("largest"), F.ceil(F.col("all") / BLOCK).cast("int").alias("n_blocks"))
    rows = cut(salted_join(grouped, mixed, ["band", "key"], F.col("rep")))
    members = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int"))
    queries = rows.where("root != largest").withColumn("block", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    placed = members.withColumn("asks", F.lit(False)).unionByName(queries.withColumn("asks", F.lit(True)))
    place = ["band", "key", "block"]
    return (
        placed.select(*place, "rep", "root", "asks")
        .join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .groupBy(*place).applyInArrow(compare(percent), "a long, b long")
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    all_signed = cut(rows.mapInArrow(signed, "doc_id long, n long, fp1 long, fp2 long, bands array<long>"))
    members = all_signed.where("doc_id is not null and n > 0")
    classes = cut(
        members.groupBy("fp1", "fp2", "n")
        .agg(F.min(F.struct("doc_id", "bands")).alias("m"))
        .select("fp1", "fp2", "n", F.col("m.doc_id").alias("rep"), "m.bands")
    )
    in_buckets = classes.select("rep", "fp1", F.posexplode("bands").alias("band", "key"))
    # Similar classes meet in several bands; of buckets with the same members one is looked at.
    members_of = [F.bit_xor(F.xxhash64("rep", "fp1", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    shared = (
        in_buckets.groupBy("band", "key")
        .agg(F.min("rep").alias("pivot"), F.max("rep").alias("most"), F.count(F.lit(1)).alias("n"), *members_of)
        .where("pivot < most")
        .groupBy("pivot", "most", "n", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("bucket"))
        .select("bucket.*", "pivot")
    )
    held = cut(salted_join(in_buckets.drop("fp1"), shared, ["band", "key"], F.col("rep")))
    stars = cut(held.where("rep > pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    # Of documents with several rows, all rows' sets are candidates under the one id.
    involved = held.select(F.col("rep").alias("doc_id")).distinct()
    # Shuffled at every size, so that what it costs follows the input.
    sets = cut(rows.join(involved.hint("merge"), "doc_id", "left_semi").mapInArrow(whole_sets, "doc_id long, items array<long>"))
    links = verified(stars, sets, percent)
    # A copy's link with its class's smallest document.
    copies = members.join(classes.select("fp1", "fp2", "n", "rep"), ["fp1", "fp2", "n"]).where("doc_id > rep").select("doc_id", "rep")
    links = cut(links.union(copies.select(F.col("rep"), F.col("doc_id"))))
    roots = components(links)
    more = links_across(held, roots, sets, percent)
    final = components(roots.select("root", "node").union(more))
    return (
        all_signed.select("doc_id", "n")
        .join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"),
            F.coalesce(F.col("root") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose document is the smallest of its group, all columns kept."""
    others = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("_other"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
