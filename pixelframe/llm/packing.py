"""Hierarchical packing into several context sizes.

Every document is tokenized and ends with id 0. Whole windows of the largest size are cut off first;
what remains of a document is routed to the tier of the smallest size that holds it. Each tier's
windows begin with its own documents, longest first, and their gaps are filled from shorter tiers by
best fit, cutting a document only where nothing fits. Sequences therefore are full: their lengths
are the tiers' sizes. What a task has left at its end, less than the smallest size, descends
through smaller powers of two. Sequences of one tier are dealt out to step groups of equal token
counts so that the attention cost (sum of squared piece lengths) is even among groups.

A task packs its rows in buffers of bounded size, with nothing shuffled: padding would be lost per
task, not per corpus, and there is none. Sequence and group ids carry the partition's number.
Null text is empty: one piece, id 0 alone. Null doc_id is kept. Repeated rows are packed each.
"""

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import documents

SIZES = (1024, 512, 256, 128)
END = 0
BUFFER = 1 << 19  # tokens that a task packs at once
GROUP = 1 << 14  # tokens of a step group
POOL = 16  # step groups that are balanced against each other

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("tier", pa.int64()), ("step_group", pa.int64()),
])
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier long, step_group long")


def encoder(path: str):
    """text -> ids. The byte-level BPE vocabulary of `path`, by the faster of two libraries that read it."""
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranked = f"{os.path.splitext(path)[0]}.tiktoken"
    if os.path.exists(ranked):  # the same vocabulary, listed as ranks
        with open(ranked, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return fast.encode_ordinary
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids


# A piece is (document, start, length); a document is (doc_id, ids).
def pack_windows(pieces: list, sizes: tuple[int, ...]) -> tuple[list, list]:
    """Full windows made of `pieces`, each at most sizes[0] long, and the pieces left over."""
    windows: list[list] = []
    by_length = sorted(((p[2], p[0], p[1]) for p in pieces))  # short to long
    total = sum(x[0] for x in by_length)

    def take(gap: int) -> list:
        """The longest piece that fits; else the head of the shortest, whose tail goes back."""
        k = bisect_right(by_length, (gap, float("inf"), 0))
        if k:
            length, doc, start = by_length.pop(k - 1)
            return [doc, start, length]
        length, doc, start = by_length.pop(0)
        insort(by_length, (length - gap, doc, start + gap))
        return [doc, start, gap]

    for size, least in zip(sizes, [*sizes[1:], 0]):
        while by_length and by_length[-1][0] > least and total >= size:
            window, gap = [], size
            while gap:
                window.append(take(gap) if window else take(size))
                gap -= window[-1][2]
            windows.append(window)
            total -= size
    return windows, [[doc, start, length] for length, doc, start in by_length]


def tail_windows(pieces: list, sizes: tuple[int, ...]) -> list:
    """The last pieces of a task in windows of falling powers of two, none of them padded."""
    total, windows = sum(p[2] for p in pieces), []
    for size in (1 << k for k in range(sizes[0].bit_length() - 1, -1, -1)):
        while total >= size:
            found, pieces = pack_windows(pieces, (size,)) if all(p[2] <= size for p in pieces) else cut_one(pieces, size)
            windows += found
            total = sum(p[2] for p in pieces)
    return windows


def cut_one(pieces: list, size: int) -> tuple[list, list]:
    """One window of `size` from the head of the longest piece."""
    k = max(range(len(pieces)), key=lambda i: pieces[i][2])
    doc, start, length = pieces[k]
    rest = [*pieces[:k], *pieces[k + 1:]]
    return [[[doc, start, size]]], [*rest, [doc, start + size, length - size]] if length > size else rest


def deal(windows: list, size: int) -> list[list]:
    """Windows of one size in groups of GROUP tokens, costly ones spread evenly (to and fro over the groups)."""
    each = max(1, GROUP // size)
    n = -(-len(windows) // each)
    ordered = sorted(windows, key=lambda w: -sum(p[2] ** 2 for p in w))
    groups: list[list] = [[] for _ in range(n)]
    for i, w in enumerate(ordered):
        turn, k = divmod(i, n)
        groups[k if turn % 2 == 0 else n - 1 - k].append(w)
    return groups


def packer(path: str, sizes: tuple[int, ...]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(path), TaskContext.get().partitionId() << 33
        docs: dict[int, tuple] = {}  # number in this task -> (doc_id, ids), while pieces of it wait
        waiting: list = []
        pools: dict[int, list] = {}
        ids = {"seq": base, "group": base, "doc": 0}
        held = 0

        def out(rows: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

        def rows_of(groups: list, size: int) -> list:
            rows = []
            for group in groups:
                for window in group:
                    at = 0
                    for doc, start, length in window:
                        doc_id, tokens = docs[doc]
                        crc = zlib.crc32(tokens[start:start + length].tobytes())
                        rows.append((doc_id, start, length, crc, len(tokens), ids["seq"], at, size, ids["group"]))
                        at += length
                    ids["seq"] += 1
                ids["group"] += 1
            return rows

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, docs
            windows, waiting = pack_windows(waiting, sizes)
            if last:
                windows += tail_windows(waiting, sizes)
                waiting = []
            for window in windows:
                pools.setdefault(sum(p[2] for p in window), []).append(window)
            for size in sorted(pools, reverse=True):
                per_pool = POOL * max(1, GROUP // size)
                while len(pools[size]) >= per_pool or last and pools[size]:
                    yield out(rows_of(deal(pools[size][:per_pool], size), size))
                    del pools[size][:per_pool]
            used = {p[0] for p in waiting} | {p[0] for ws in pools.values() for w in ws for p in w}
            docs = {k: docs[k] for k in used}

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                tokens = np.array([*encode(text or ""), END], "<u4")
                number = ids["doc"]
                ids["doc"] += 1
                docs[number] = (doc_id, tokens)
                whole = len(tokens) - len(tokens) % sizes[0]
                pools.setdefault(sizes[0], []).extend([[number, s, sizes[0]]] for s in range(0, whole, sizes[0]))
                if whole < len(tokens):
                    waiting.append([number, whole, len(tokens) - whole])
                held += len(tokens)
                if held >= BUFFER:
                    yield from flush(False)
                    held = 0
        yield from flush(True)

    return pack


def pack(docs: DataFrame, tokenizer: str, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """Pieces of all documents with the sequence and step group that each goes to."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(packer(tokenizer, sizes), SCHEMA)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
