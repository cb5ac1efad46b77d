"""Vectors of whole numbers, packed in blocks of rows for NumPy, and searches that stream blocks past queries.

A block row holds up to `size` vectors as bytes. A search brings one block of queries and a group of
candidate blocks to each task: `stream` keeps the queries and sees the candidates one block at a time, so memory
is two blocks and what the search remembers, whatever the number of rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelframe.session import cut

EXACT = 2.0**53  # whole numbers below it are exact as doubles
FIELDS = "n int, width int, rows binary, ids binary, marks binary, longest double, data binary"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def whole(df: DataFrame, vector: str, scale: int, row_id: str, mark: Column | None = None) -> DataFrame:
    """(row, vec_id, mark, v): components as floor(scale * x), x as double, in a written table.

    `row` tells equal rows apart. Rows without an id, a mark or a vector, or with a null or non-finite
    component, are left out. A component outside the range of long becomes its end.
    """
    inf = F.lit(float("inf"))
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < inf))
    rows = df.where(F.col(vector).isNotNull() & F.col(row_id).isNotNull()).where(F.coalesce(usable, F.lit(False)))
    v = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    picked = rows.select(
        F.col(row_id).cast("long").alias("vec_id"), (F.lit(0) if mark is None else mark).cast("long").alias("mark"), v.alias("v")
    )
    return cut(picked.where("mark is not null").select(F.monotonically_increasing_id().alias("row"), "*"))


def squared_length(v: str = "v") -> Column:
    return F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x)


@dataclass
class Block:
    rows: np.ndarray
    ids: np.ndarray
    marks: np.ndarray
    data: np.ndarray  # a row per vector, short ones filled up with zeros
    longest: float
    extra: bytes | None = None


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as an array with a row per list, short ones filled up with zeros."""
    offsets = np.asarray(column.offsets)
    widths = np.diff(offsets)
    values = np.asarray(column.values)[offsets[0]:offsets[-1]]
    width = int(widths.max(initial=0))
    if (widths == width).all():
        return values.reshape(len(widths), width)
    out = np.zeros((len(widths), width), np.int64)
    out[np.arange(width) < widths[:, None]] = values
    return out


def packer(size: int, keys: list[str]):
    """Rows (keys, row, vec_id, mark, v) of one task to blocks in their order; `keys` are of the block's first row."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        column = lambda name: table.column(name).combine_chunks()
        data = np.ascontiguousarray(matrix(column("v")), np.int64)
        arrays = [np.asarray(column(c), np.int64).tobytes() for c in ("row", "vec_id", "mark")]
        longest = float(np.sqrt((data.astype(float) ** 2).sum(axis=1).max(initial=0.0)))
        row = [table.num_rows, data.shape[1], *arrays, longest, data.tobytes()]
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 3, pa.float64(), pa.binary()]
        first = [table.column(k).slice(0, 1).combine_chunks() for k in keys]
        return pa.record_batch([*first, *[pa.array([x], t) for x, t in zip(row, types)]], names=[*keys, *NAMES])

    def pack(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece, batch = batch.slice(0, size - n), batch.slice(size - n)
                held.append(piece)
                n += piece.num_rows
                if n == size:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return pack


def blocks(rows: DataFrame, size: int, keys: str = "") -> DataFrame:
    """Vectors packed where they are, `size` to a block; `keys` is a schema of further columns, each one value a task."""
    names = [x.split()[0] for x in keys.split(", ") if x]
    return rows.select(*names, "row", "vec_id", "mark", "v").mapInArrow(packer(size, names), f"{keys + ', ' if keys else ''}{FIELDS}")


def unpack(row: dict) -> Block:
    n, width = row["n"], row["width"]
    rows, ids, marks = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "marks"))
    return Block(rows, ids, marks, np.frombuffer(row["data"], np.int64).reshape(n, width), row["longest"], row.get("extra"))


def numbered(rows: DataFrame, size: int, parts: int, name: str, longest_first: bool = False, whole_blocks: bool = False) -> DataFrame:
    """Blocks (name, at, block) in a written table: rows dealt to about `parts` pieces, `name` the piece, `at` the order in it.

    With `longest_first` no vector of a piece or block is longer than one of a piece or block before it; ties of length are
    told apart by `row`, so that equal vectors spread as others do. `whole_blocks` joins pieces until there are `parts` of
    them at most: blocks of queries are best as full as can be, as each one meets all candidates.
    """
    if longest_first:
        order = [F.desc("length2"), F.col("row")]
        dealt = rows.withColumn("length2", squared_length()).repartitionByRange(parts, *order)
        dealt = (dealt.coalesce(parts) if whole_blocks else dealt).sortWithinPartitions(*order)
    else:
        dealt = rows.repartition(parts, "row")
        dealt = dealt.coalesce(parts) if whole_blocks else dealt
    packed = blocks(dealt.withColumn(name, F.spark_partition_id()), size, f"{name} int")
    return cut(packed.withColumn("at", F.monotonically_increasing_id()))


def meet(pairs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """For every (qb, part) of `pairs` its query block and then the candidate blocks of that part in order, in one task.

    `queries` is (qb, extra, block), `candidates` (part, at, block). Query blocks and parts are bounded, so no key is hot.
    """
    asked = pairs.join(queries, "qb").select("qb", "part", F.lit(-1).cast("long").alias("at"), "extra", *NAMES)
    shown = pairs.join(candidates, "part").select("qb", "part", "at", F.lit(None).cast("binary").alias("extra"), *NAMES)
    return asked.unionByName(shown).repartition("qb", "part").sortWithinPartitions("qb", "part", "at")


def stream(batches) -> Iterator[tuple[int, Block, Iterator[Block]]]:
    """(qb, queries, candidate blocks) for each group of a task sorted by `meet`, one block in memory at a time."""
    rows = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
    row = next(rows, None)
    while row is not None:
        key, head = (row["qb"], row["part"]), unpack(row)
        row = None

        def group():
            nonlocal row
            for row in rows:
                if (row["qb"], row["part"]) != key:
                    return
                yield unpack(row)
            row = None

        inner = group()
        yield key[0], head, inner
        for _ in inner:  # what the search did not ask for
            pass


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of `a` and `b`; one beyond the range of long becomes its end."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a.astype(float)).max(initial=0.0)) * float(np.abs(b.astype(float)).max(initial=0.0)) * width
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    ends = np.iinfo(np.int64)
    return np.clip(exact, ends.min, ends.max).astype(np.int64)


def best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the `k` highest scores of each group, ties by smaller id; in order of group and rank."""
    order = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == np.iinfo(np.int64).min else -score, group))
    sorted_group = group[order]
    first = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
    return order[np.arange(len(order)) - start < k]
