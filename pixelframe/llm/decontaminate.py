"""Benchmark decontamination by q-gram lemma filtering.

Texts are compared as sequences of lower-case letters and digits with one blank between words. An
item is covered by overlapping segments, one every STRIDE characters, so that a verbatim quote of
SEGMENT + STRIDE - 1 of these characters is found wherever it starts; two segments within an edit budget share
at least length - q + 1 - edits * q of their q-grams, all on diagonals that differ by the budget at most.
Shared q-grams are counted in overlapping diagonal bands twice that wide, regions that meet the bound
are kept, and each is verified by an alignment inside its band and inside one document: characters of an item that
lie before a document's beginning or after its end count as edits.

Documents are searched where they are scanned, nothing is shuffled but the few hits. The items go to
the tasks in blocks of bounded size; a larger benchmark only takes more blocks.

Null text matches nothing. Items with fewer than Q characters are not searched. An item's budget is
lowered where the bound would not be positive: the shortest items match exactly. Repeated documents
are reported once per doc_id; rows without a doc_id are reported under null.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.bytehash import Rolling
from pixelframe.llm.common import documents, table
from pixelframe.llm.neardup import blocks

Q = 10
SEGMENT, STRIDE = 96, 16  # characters
RATE = 0.075  # edits per character of a segment
LEAST = 3  # shared q-grams that a budget must leave
BLOCK_BYTES = 8 << 20  # of benchmark text that a task holds at once

GAP, END_OF_TEXT = 32, 1
SCHEMA = "doc_id long, item_id long, start long, end long, edits long"


def folding() -> np.ndarray:
    """Code point below 65,536 -> the lower-case letter or digit it counts as, or GAP."""
    out = np.full(1 << 16, GAP, np.uint32)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalnum():
            lower = char.lower()
            out[code] = ord(lower) if len(lower) == 1 else code
    out[END_OF_TEXT] = END_OF_TEXT
    return out


def normal(texts: list[str], folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of folded characters, each one's source place, and where texts begin there."""
    codes = np.frombuffer("".join(f"{t}\x01" for t in (x.replace("\x01", " ") for x in texts)).encode("utf-32-le"), np.uint32)
    chars = folded[np.minimum(codes, 0xFFFF)]
    chars = np.where(codes > 0xFFFF, codes, chars)
    solid = chars != GAP
    keep = solid | np.concatenate([[False], solid[:-1]])
    places = np.flatnonzero(keep)
    begins = np.concatenate([[0], np.flatnonzero(codes == END_OF_TEXT) + 1])
    return chars[places], places, begins


def grams(chars: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams; characters enter by one byte, as verification compares them whole."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    return Rolling(((chars ^ (chars >> 7)) & 0xFF).astype(np.uint8)).grams(Q)


class Items:
    """Segments of benchmark items with an index of their q-grams."""

    def __init__(self, rows: list[tuple[int, str]], folded: np.ndarray):
        self.segments, hashes, owner, at = [], [], [], []
        for item_id, text in rows:
            chars = normal([text], folded)[0][:-1]
            if len(chars) and chars[-1] == GAP:
                chars = chars[:-1]
            if len(chars) < Q:
                continue
            size = min(SEGMENT, len(chars))
            starts = sorted({*range(0, len(chars) - size + 1, STRIDE), len(chars) - size})
            for s in starts:
                part = chars[s:s + size]
                edits = max(0, min(int(size * RATE), (size - Q + 1 - LEAST) // Q))
                g = grams(part)
                owner.append(np.full(len(g), len(self.segments)))
                self.segments.append((item_id, part, edits, size - Q + 1 - edits * Q))
                hashes.append(g)
                at.append(np.arange(len(g)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        order = np.argsort(join(hashes, np.uint64), kind="stable")
        self.hashes, self.owner, self.at = (join(x, t)[order] for x, t in ((hashes, np.uint64), (owner, np.int64), (at, np.int64)))
        self.present = np.zeros(1 << 22, bool)
        self.present[self.hashes & np.uint64((1 << 22) - 1)] = True
        self.band = np.array([2 * max(1, s[2]) for s in self.segments] or [2])
        self.bound = np.array([s[3] for s in self.segments] or [1])
        self.size = np.array([len(s[1]) for s in self.segments] or [1])

    def candidates(self, chars: np.ndarray) -> np.ndarray:
        """(segment, least diagonal of the band) with enough shared q-grams, as an array of pairs."""
        found = grams(chars)
        hits = np.flatnonzero(self.present[found & np.uint64((1 << 22) - 1)])
        if not len(hits):
            return np.zeros((0, 2), np.int64)
        # Places that cannot lie in a region with the least bound of any segment go first.
        reach, least = int(self.size.max()) + int(self.band.max()), int(self.bound.min())
        near = np.searchsorted(hits, hits + reach, "right") - np.searchsorted(hits, hits - reach, "left")
        hits = hits[near >= least]
        lo, hi = np.searchsorted(self.hashes, found[hits], "left"), np.searchsorted(self.hashes, found[hits], "right")
        n = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        segment, diagonal = self.owner[entry], np.repeat(hits, n) - self.at[entry]
        half = self.band[segment] // 2
        number = diagonal // half
        # Every hit counts in two bands, [k * half, k * half + band) and the one before.
        wide = np.int64(1) << 40  # segment and band in one key; a band's number may be negative
        pairs = np.concatenate([segment * wide + number, segment * wide + number - 1]) + (wide >> 1)
        keys, counts = np.unique(pairs, return_counts=True)
        segment, number = keys // wide, keys % wide - (wide >> 1)
        kept = counts >= self.bound[segment]
        segment, number = segment[kept], number[kept]
        return np.stack([segment, number * (self.band[segment] // 2)], 1)

    def verify(self, chars: np.ndarray, segment: int, low: int, first: int, last: int) -> tuple[int, int, int] | None:
        """(start, end, edits) of the best alignment of the segment inside its band and chars[first:last], within the budget."""
        _, part, budget, _ = self.segments[segment]
        width, n = int(self.band[segment]) + 1, len(part)
        for d in range(max(low, first), min(low + width, last - n + 1)):
            wrong = int((chars[d:d + n] != part).sum())
            if wrong <= budget:
                return d, d + n, wrong
        lanes = np.arange(width)
        padded = np.full(n + 2 * width, 0, np.uint32)
        begin_at = low - 1
        a, b = max(begin_at, first), min(begin_at + n + width, last)
        if a < b:
            padded[a - begin_at:b - begin_at] = chars[a:b]
        cost, begin = np.zeros(width, np.int64), low + lanes
        for i in range(n):
            direct = cost + (padded[i + 1 + lanes] != part[i])
            skip = np.append(cost[1:] + 1, 1 << 20)  # an item's character that the document lacks
            better = skip < direct
            here, since = np.where(better, skip, direct), np.where(better, np.append(begin[1:], 0), begin)
            # Extra characters of the document move right along the lanes, one edit each.
            run = np.minimum.accumulate(here - lanes)
            source = np.maximum.accumulate(np.where(here - lanes == run, lanes, -1))
            cost, begin = run + lanes, since[source]
        k = int(cost.argmin())
        start, end = max(int(begin[k]), first), min(low + n + k, last)
        return (start, end, int(cost[k])) if cost[k] <= budget and start < end else None

    def found(self, chars: np.ndarray):
        """(segment, document, start, end, edits) of verified regions; texts end at END_OF_TEXT."""
        stops = np.flatnonzero(chars == END_OF_TEXT)
        for segment, low in self.candidates(chars).tolist():
            _, part, budget, _ = self.segments[segment]
            width = int(self.band[segment]) + 1
            high = low + width + len(part)
            doc = int(np.searchsorted(stops, max(low, 0)))
            while doc < len(stops):
                first, last = int(stops[doc - 1]) + 1 if doc else 0, int(stops[doc])
                if first >= high:
                    break
                # A document that holds too little of the region cannot be within the budget.
                if min(last, high) - max(first, low) >= len(part) - budget:
                    if hit := self.verify(chars, segment, low, first, last):
                        yield segment, doc, *hit
                doc += 1


def searcher(rows: list[tuple[int, str]]):
    def search(batches):
        folded = folding()
        items = Items(rows, folded)
        for whole in batches:
            for batch in blocks(whole):
                chars, places, begins = normal([x or "" for x in batch.column("text").to_pylist()], folded)
                ids, out = batch.column("doc_id").to_pylist(), []
                for segment, doc, start, end, edits in items.found(chars):
                    begin = int(begins[doc])
                    a, b = int(places[start]) - begin, int(places[end - 1]) + 1 - begin
                    out.append((ids[doc], items.segments[segment][0], a, b, edits))
                columns = list(zip(*out)) or [()] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start", "end", "edits"])

    return search


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_segments): items found in documents.

    start and end are the code points of the text between which segments of the item lie; edits is
    the least distance of one of them.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = int(total) // block_bytes + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k).collect()
        hits = rows.mapInArrow(searcher(sorted((r.item_id, r.text) for r in part)), SCHEMA)
        found = hits if found is None else found.union(hits)
    return found.groupBy("doc_id", "item_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("edits").alias("edits"),
        F.countDistinct("start", "end").alias("n_segments"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found, all columns kept."""
    held = matches(docs, benchmark).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("_held")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
