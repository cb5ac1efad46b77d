"""Substring dedup: bytes covered by a LENGTH-byte string that also starts in an earlier document.

Every LENGTH-byte window has an anchor, the least hash among its GRAM-byte substrings; runs of
windows with one anchor form a piece, so equal text is cut into equal pieces wherever it stands.
Documents lie in chunks of bounded size, and each chunk makes a sparse suffix array of the suffixes
at its pieces' starts by deep-shallow sorting: equal pieces are adjacent and form classes.

1. A chunk tells which anchors it has, and hears which of them other chunks share. All else is
   settled inside the chunk.
2. Of shared anchors it tells the only class's fingerprint and first document, or that there are
   several classes. Where an anchor has one class in all chunks, its first document anywhere is
   known, and the class is settled.
3. Other anchors stand at the edges of repeats. Their classes' windows are told one by one,
   as fingerprints with their first documents.
4. Each chunk marks the windows whose first document is a smaller one.

A chunk tells an anchor or a window once, so a passage that a third of all documents share is one
record of each chunk; what differs spreads by its hash. Texts are shuffled once to their chunks.
Fingerprints have 64 bits.

Null text is empty. Rows without a doc_id take no part and lose nothing; rows that share a doc_id
are not earlier than each other. The order of rows plays no part.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.bytehash import Powers, Rolling
from pixelframe.llm.common import documents, shuffle_width
from pixelframe.llm.suffixsort import deep_shallow

LENGTH = 50
GRAM = 24
LONGEST = 64  # windows of a piece
CHUNK_BYTES = 8 << 20
BLOCK = 1 << 20  # bytes hashed at once
SEVERAL = np.uint64(0)  # in place of a fingerprint


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:len(x) - (width - done)], x[width - done:]) if width > done else x


class Chunk:
    """The documents of one chunk in doc_id order, with their pieces and classes."""

    def __init__(self, rows: pa.Table, length: int):
        self.length, self.powers = length, Powers(BLOCK + (BLOCK >> 2))
        ids, texts = rows.column("doc_id").to_pylist(), [x or b"" for x in rows.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        known = len(self.ids) - self.ids.count(None)
        self.doc_of = np.array([x or 0 for x in self.ids], np.int64)
        found, at = [], 0
        while at < known:
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + BLOCK)) - 1)
            to = min(to, known)
            found.append(self.pieces(at, to))
            at = to
        join = lambda k, t: np.concatenate([f[k] for f in found]).astype(t) if found else np.zeros(0, t)
        self.start, self.count, self.anchor = join(0, np.int64), join(1, np.int64), join(2, np.uint64)

    def sort(self) -> "Chunk":
        """Finds the classes of the pieces and, by anchor, the classes there are."""
        self.doc = self.doc_of[np.searchsorted(self.offsets, self.start, "right") - 1] if len(self.start) else np.zeros(0, np.int64)
        _, self.cls = deep_shallow(self.data, self.start, self.count + self.length - 1)
        # The first piece of a class is of its first document.
        _, self.head = np.unique(self.cls, return_index=True)
        self.anchors, first, self.anchor_of, self.n_classes = np.unique(
            self.anchor[self.head], return_index=True, return_inverse=True, return_counts=True)
        self.only = self.head[first]  # a piece of each anchor's class, if there is but one
        return self

    def pieces(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows and anchor of the pieces of documents a to b."""
        base = int(self.offsets[a])
        data, ends = self.data[base:self.offsets[b]], self.offsets[a:b + 1] - base
        n = len(data) - self.length + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
        least = sliding_min(Rolling(data, self.powers).grams(GRAM), self.length - GRAM + 1)
        stop = np.repeat(ends[1:], np.diff(ends))[:n] - self.length + 1  # first window that leaves its document
        inside = np.arange(n) < stop
        new = inside & np.append(True, (least[1:] != least[:-1]) | (stop[1:] != stop[:-1]))
        start = np.flatnonzero(new)
        count = np.minimum(np.append(start[1:], n), stop[start]) - start
        if len(count) and count.max() > LONGEST:  # of periodic text
            parts = -(-count // LONGEST)
            which = np.repeat(np.arange(len(start)), parts)
            k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
            start, count = start[which] + k * LONGEST, np.minimum(LONGEST, count[which] - k * LONGEST)
        return start + base, count, least[start]

    def fingerprints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of data[start:end], the same in every chunk. Strings are taken in blocks."""
        out = np.zeros(len(start), np.uint64)
        order = np.argsort(start, kind="stable")
        at = 0
        while at < len(order):
            base = start[order[at]]
            to = int(np.searchsorted(start[order], base + BLOCK, "left"))
            who = order[at:to]
            out[who] = Rolling(self.data[base:end[who].max()], self.powers).spans(start[who] - base, end[who] - base)
            at = to
        return out | np.uint64(1)

    def told(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of these anchors: the fingerprint of its only class (or SEVERAL), the class's first document."""
        only = self.only[which]
        prints = self.fingerprints(self.start[only], self.start[only] + self.count[only] + self.length - 1)
        return np.where(self.n_classes[which] > 1, SEVERAL, prints), self.doc[only]

    def windows(self, edge: np.ndarray) -> "Windows":
        return Windows(self, edge)


class Windows:
    """Distinct windows of the classes under `edge` anchors: fingerprints and first documents."""

    def __init__(self, chunk: Chunk, edge: np.ndarray):
        chosen = np.flatnonzero(edge[chunk.anchor_of])
        chosen = chosen[np.argsort(chunk.head[chosen], kind="stable")]  # by document
        heads = chunk.head[chosen]
        count = chunk.count[heads]
        at = spread(chunk.start[heads], count)
        self.prints, first, self.number = np.unique(
            chunk.fingerprints(at, at + chunk.length), return_index=True, return_inverse=True)
        self.first = np.repeat(chunk.doc[heads], count)[first]
        self.begin = np.zeros(len(chunk.head), np.int64)  # of each class, in `number`
        self.begin[chosen] = np.cumsum(count) - count

    def of(self, classes: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of all windows of pieces, given their classes and counts."""
        return self.number[spread(self.begin[classes], count)]


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start+1, ... count of each."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


TOLD = "bucket long, chunk long, hashes binary, prints binary, base long, docs binary"
REPLY = "chunk long, bucket long, step int, flags binary, at binary, docs binary"
SHARED, FIRSTS, WINDOWS = 0, 1, 2  # steps


def dealt(hashes: np.ndarray, docs: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """The buckets that hashes fall in, with the places of each one's hashes by document."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(n)
    order = np.lexsort((docs, bucket))
    names, first = np.unique(bucket[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, first[1:])))


def narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(t[2]))).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def mail(chunk: int, hashes: np.ndarray, prints: np.ndarray | None, docs: np.ndarray, n: int, width: str) -> pa.Table:
    """A row per bucket that these hashes fall in; documents ascend and are told by their differences."""
    rows = []
    for b, at in dealt(hashes, docs, n):
        own = prints[at].tobytes() if prints is not None else b""
        rows.append((b, chunk, hashes[at].astype(width).tobytes(), own, int(docs[at[0]]), narrow(np.diff(docs[at], prepend=docs[at[0]]))))
    columns = list(zip(*rows)) or [()] * 6
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "chunk", "hashes", "prints", "base", "docs"])


def opened(rows: pa.Table, width: str) -> tuple[np.ndarray, ...]:
    """Hash, fingerprint, document, row number and place in the row of all a bucket was told."""
    hashes = [np.frombuffer(x, width) for x in rows.column("hashes").to_pylist()]
    prints = [np.frombuffer(x, "<u8") for x in rows.column("prints").to_pylist()]
    docs = [np.cumsum(wide(x, len(h))) + base for x, h, base in zip(rows.column("docs").to_pylist(), hashes, rows.column("base").to_pylist())]
    row = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    place = np.concatenate([np.arange(len(h)) for h in hashes])
    return np.concatenate(hashes), np.concatenate(prints), np.concatenate(docs), row, place


def replies(rows: pa.Table, step: int, row, place, flagged, smaller, docs) -> pa.Table:
    """To each chunk: which of its hashes are flagged, and smaller first documents of others."""
    out = []
    bounds = np.searchsorted(row, np.arange(rows.num_rows + 1))
    for r, (chunk, bucket) in enumerate(zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist())):
        part = slice(bounds[r], bounds[r + 1])
        f, s = flagged[part], smaller[part]
        if f.any() or s.any():
            out.append((chunk, bucket, step, np.packbits(f).tobytes(), narrow(place[part][s]), docs[part][s].astype("<i8").tobytes()))
    columns = list(zip(*out)) or [()] * 6
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["chunk", "bucket", "step", "flags", "at", "docs"])


def judge_shared(rows: pa.Table) -> pa.Table:
    """Anchors that several chunks have."""
    hashes, _, docs, row, place = opened(rows, "<u4")
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    return replies(rows, SHARED, row, place, counts[inverse] > 1, np.zeros(len(hashes), bool), docs)


def judge_anchors(rows: pa.Table) -> pa.Table:
    """Shared anchors with several classes are edges; of others the first document is found."""
    hashes, prints, docs, row, place = opened(rows, "<u4")
    order = np.lexsort((docs, hashes))
    h, p, d = hashes[order], prints[order], docs[order]
    new = np.append(True, h[1:] != h[:-1])
    group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    differ = np.maximum.reduceat(p, heads) != np.minimum.reduceat(p, heads)
    several = differ | (np.minimum.reduceat(p, heads) == SEVERAL)
    first = np.empty(len(h), np.int64)
    first[order] = d[heads][group]
    edge = np.empty(len(h), bool)
    edge[order] = several[group]
    return replies(rows, FIRSTS, row, place, edge, ~edge & (first < docs), first)


def judge_windows(rows: pa.Table) -> pa.Table:
    """The first document of every window told."""
    hashes, _, docs, row, place = opened(rows, "<u8")
    order = np.lexsort((docs, hashes))
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    first = np.empty(len(hashes), np.int64)
    first[order] = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return replies(rows, WINDOWS, row, place, np.zeros(len(hashes), bool), first < docs, first)


def heard(answers: pa.Table, step: int, hashes: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of hashes that were told with `docs`, and their first documents anywhere, from a step's replies."""
    flagged, first = np.zeros(len(hashes), bool), docs.copy()
    own = dict(dealt(hashes, docs, n)) if len(hashes) else {}
    for b, s, f, at, d in zip(*(answers.column(c).to_pylist() for c in ("bucket", "step", "flags", "at", "docs"))):
        if s == step:
            places = own[b]
            flagged[places] = np.unpackbits(np.frombuffer(f, np.uint8), count=len(places)).astype(bool)
            first[places[wide(at, len(d) // 8)]] = np.frombuffer(d, "<i8")
    return flagged, first


class Heard:
    """What a chunk knows of its anchors after the replies that have come."""

    def __init__(self, chunk: Chunk, answers: pa.Table, n: int):
        count = len(chunk.anchors)
        self.shared, _ = heard(answers, SHARED, chunk.anchors, np.zeros(count, np.int64), n)
        which = np.flatnonzero(self.shared)
        self.told = (chunk.anchors[which], *chunk.told(which))
        edge, first = heard(answers, FIRSTS, self.told[0], self.told[2], n)
        self.edge = np.zeros(count, bool)  # of anchors that other chunks share
        self.edge[which] = edge
        self.inner = (chunk.n_classes > 1) & ~self.shared  # edges inside this chunk
        self.first = chunk.doc[chunk.only]
        self.first[which] = first


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def marked(chunk: Chunk, answers: pa.Table, n: int) -> pa.Table:
    """Each document of the chunk without its repeated bytes."""
    known = Heard(chunk, answers, n)
    anchor = chunk.anchor_of[chunk.cls]  # of each piece
    width = chunk.length
    gone = ~known.edge[anchor] & ~known.inner[anchor] & (known.first[anchor] < chunk.doc)
    begin, end = [chunk.start[gone]], [chunk.start[gone] + chunk.count[gone] + width - 1]
    for edge in (known.edge, known.inner):
        windows = chunk.windows(edge)
        first = windows.first
        if edge is known.edge:
            _, first = heard(answers, WINDOWS, windows.prints, first, n)
        pieces = np.flatnonzero(edge[anchor])
        for part in np.array_split(pieces, int(chunk.count[pieces].sum()) // BLOCK + 1):
            if len(part):
                at = spread(chunk.start[part], chunk.count[part])
                since = first[windows.of(chunk.cls[part], chunk.count[part])]
                at = at[since < np.repeat(chunk.doc[part], chunk.count[part])]
                begin.append(at)
                end.append(at + width)
    size = len(chunk.data) + 1
    depth = np.bincount(np.concatenate(begin), minlength=size) - np.bincount(np.concatenate(end), minlength=size)
    removed = np.cumsum(depth)[:-1] > 0
    rows = []
    for i, doc_id in enumerate(chunk.ids):
        a, b = chunk.offsets[i], chunk.offsets[i + 1]
        cut = removed[a:b]
        spans = int((np.diff(np.concatenate([[0], cut.view(np.int8)])) == 1).sum())
        kept = chunk.data[a:b][~cut].tobytes() if spans else chunk.texts[i]
        rows.append((doc_id, int(b - a), int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()))
    columns = list(zip(*rows)) or [()] * 5
    types = [pa.int64()] * 4 + [pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of `docs`."""
    if length < GRAM:
        raise ValueError(f"strings have {GRAM} bytes at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(int(size) // chunk_bytes + 1, shuffle_width(docs.sparkSession))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    chunks = rows.groupBy("chunk")

    def number(table: pa.Table) -> int:
        return table.column("chunk")[0].as_py()

    def ask(table: pa.Table) -> pa.Table:
        anchors = np.unique(Chunk(table, length).anchor)
        return mail(number(table), anchors, None, np.zeros(len(anchors), np.int64), n, "<u4")

    def tell(table: pa.Table, answers: pa.Table) -> pa.Table:
        return mail(number(table), *Heard(Chunk(table, length).sort(), answers, n).told, n, "<u4")

    def tell_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table, length).sort()
        windows = chunk.windows(Heard(chunk, answers, n).edge)
        return mail(number(table), windows.prints, None, windows.first, n, "<u8")

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        return marked(Chunk(table, length).sort(), answers, n)

    def judged(told: DataFrame, judge) -> DataFrame:
        return told.groupBy("bucket").applyInArrow(judge, REPLY)

    def informed(answers: DataFrame, act, schema: str) -> DataFrame:
        return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(act, schema)

    shared = judged(chunks.applyInArrow(ask, TOLD), judge_shared)
    firsts = shared.union(judged(informed(shared, tell, TOLD), judge_anchors))
    windows = judged(informed(firsts, tell_windows, TOLD), judge_windows)
    return informed(firsts.union(windows), mark, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
