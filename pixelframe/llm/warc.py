"""WARC archives: writing with revisits, reading with boundary-chain verification.

Writing goes through Spark's text sink: a record is one string and the line separator is the blank
line that ends a record, so a gzip part file is an archive. Of pages with equal payloads, the one
with the largest page_id is the response; the others are revisits of it.

Reading splits each archive at the record magic, which also occurs inside payloads. Tasks emit every
candidate record with its offset and that of its successor, in runs: consecutive candidates each of
which ends where the next begins. From the run at offset 0, pointer jumping over the runs finds the
records that a reader from the file's start would meet; other candidates lie inside payloads.

Where a candidate does not begin at the end of the last record that the reading task has met itself, it is emitted, but
what follows its own row is not hashed: payloads full of false records take linear time. A record cut short or altered reads back with `sound` false. Where
the chain of a file ends before the file does, `damage` tells at which byte, and how many bytes are out of reach.

Null html is an empty payload. Null page_id rows are written, and read back as null; such a page is
the response of its payload only if no page with an id has it. Pages that share the largest page_id
and the payload are all responses. A null or multi-line url is written as one line.
"""

import base64
import hashlib
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pixelframe.llm.common import table
from pixelframe.session import cut, ensure_checkpoint_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SALT = 16  # parts in which the pages of one payload are joined with their response


def records(pages: DataFrame) -> DataFrame:
    """(value): a WARC record per page, without the blank line that ends it."""
    rows = pages.select(
        "page_id", F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumn("payload", F.sha2(F.encode("html", "UTF-8"), 256))
    chosen = (
        rows.groupBy("payload").agg(F.max("page_id").alias("response"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(chosen, ["payload", "salt"])
    revisit = ~F.col("page_id").eqNullSafe(F.col("response"))
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("html")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(
        F.lit(MAGIC),
        field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text, F.lit(">"))),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.encode("html", "UTF-8")))),
        field("WARC-Payload-Length", F.octet_length("html").cast("string")),
        F.when(revisit, field("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("response").cast("string"), F.lit(">")))).otherwise(""),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    records(pages).write.option("lineSep", END).option("compression", "gzip").text(path)


CANDIDATES = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("succ", pa.int64()), ("run", pa.int64()),
    ("kind", pa.string()), ("page", pa.int64()), ("refers", pa.int64()), ("sha1", pa.string()),
    ("length", pa.int64()), ("sound", pa.bool_()),
])
FOUND = ("file string, start long, succ long, run long, kind string, page long, refers long, sha1 string, length long, "
         "sound boolean")
EOF = "eof"  # kind of the mark at each file's end


class Candidate:
    """A record as its header claims it, hashing its payload as rows of the file come by."""

    def __init__(self, file: str, start: int, row: bytes):
        head, _, rest = row.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n") if b": " in line)
        get = lambda name: fields.get(name, b"").decode("utf-8", "replace")
        number = lambda x: int(x) if x.lstrip("-").isdigit() else None
        self.file, self.start, self.kind = file, start, get(b"WARC-Type")
        self.page = number(get(b"WARC-Record-ID")[10:-1])
        self.refers = number(get(b"WARC-Refers-To")[10:-1])
        self.claimed, self.full = get(b"WARC-Payload-Digest")[5:], number(get(b"WARC-Payload-Length"))
        size = number(get(b"Content-Length"))
        self.valid = bool(_) and size is not None and size >= 0
        self.missing = (size or 0) if self.valid else 0
        self.succ = start + len(MAGIC) + len(head) + 4 + self.missing + len(END)
        self.hash, self.length, self.in_http = hashlib.sha1(), 0, True
        self.http = b""
        if self.valid:
            self.feed(rest)

    def feed(self, data: bytes) -> None:
        data = data[: self.missing]
        self.missing -= len(data)
        if self.in_http:
            self.http += data
            head, found, data = self.http.partition(b"\r\n\r\n")
            if not found:
                return
            self.in_http, self.http = False, b""
        self.length += len(data)
        self.hash.update(data)

    def row(self, run: int) -> tuple:
        digest = self.hash.hexdigest()
        sound = self.missing == 0 and (self.kind == "revisit" or (digest, self.length) == (self.claimed, self.full))
        return (self.file, self.start, self.succ, run, self.kind, self.page, self.refers,
                self.claimed if self.kind == "revisit" else digest,
                self.full if self.kind == "revisit" else self.length, sound)


def candidates(batches):
    """Rows of archives, split at the magic and in file order, to candidates with their successors."""
    file, at, run, last, met = None, 0, 0, None, 0  # met: end of the last record that this task has reached itself
    still: list[tuple[Candidate, int]] = []  # candidates whose block goes on after the row they began in
    done: list[tuple] = []

    def table():
        rows = [*zip(*done)] or [[]] * len(CANDIDATES)
        done.clear()
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(rows, CANDIDATES)], schema=CANDIDATES)

    def end_file():
        done.extend(c.row(r) for c, r in still)
        still.clear()
        if file is not None and at:
            done.append((file, at, None, None, EOF, None, None, None, None, None))

    for batch in batches:
        for name, value in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            if name != file:
                end_file()
                file, run, last, met = name, 0, None, 0
                at = len(value)  # what stands before the first magic
                continue
            for c, _ in still:
                c.feed(MAGIC.encode())
                c.feed(value)
            found = Candidate(name, at, value)
            if found.valid:
                if last != found.start:
                    run = found.start
                last = found.succ
                if found.start == met:
                    met = found.succ
                    still.append((found, run))
                else:
                    done.append(found.row(run))
            done.extend(c.row(r) for c, r in still if not c.missing)
            still = [x for x in still if x[0].missing]
            at += len(MAGIC) + len(value)
        if done:
            yield table()
    end_file()
    yield table()


def reachable_runs(found: DataFrame) -> DataFrame:
    """(file, run, entry): runs met from offset 0, and where the chain enters them, by pointer jumping."""
    lasts = found.groupBy("file", "run").agg(F.max_by("succ", "start").alias("exit"))
    heads = found.select("file", F.col("start").alias("exit"), F.col("run").alias("next"))
    hops = cut(lasts.join(heads, ["file", "exit"], "left").select("file", "run", "next", "exit"))
    jumps = hops.where("next is not null").select("file", "run", "next")
    met = hops.where("run = 0").select("file", "run")
    while True:
        known = met.count()
        further = met.join(jumps, ["file", "run"]).select("file", F.col("next").alias("run"))
        met = cut(met.union(further).distinct())
        if met.count() == known:
            break
        after = jumps.select("file", F.col("run").alias("next"), F.col("next").alias("far"))
        jumps = cut(jumps.join(after, ["file", "next"]).select("file", "run", F.col("far").alias("next")))
    entries = met.join(hops, ["file", "run"]).where("next is not null").select("file", F.col("next").alias("run"), F.col("exit").alias("entry"))
    return entries.union(met.where("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry")))


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of all archives in `path` with their successors, and a mark at each file's end."""
    rows = (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    )
    return cut(rows.mapInArrow(candidates, FOUND))


def reached(marks: DataFrame) -> DataFrame:
    """Of `scanned` rows, the records that a reader from each file's start meets."""
    found = marks.where(F.col("kind") != EOF)
    return found.join(reachable_runs(found), ["file", "run"]).where("start >= entry").drop("run", "entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, kind, page, refers, sha1, length, sound) of the records of all archives in `path`."""
    return reached(scanned(spark, path)).drop("succ")


def damage(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, lost): files whose chain ends elsewhere than the file; `lost` bytes from `at` on, below 0 where the
    last record claims more than there is. An archive that does not begin with a record is lost from 0 on."""
    marks = scanned(spark, path)
    ends = reached(marks).groupBy("file").agg(F.max("succ").alias("at"))
    sizes = marks.where(F.col("kind") == EOF).select("file", F.col("start").alias("size"))
    at = F.coalesce("at", F.lit(0).cast("long"))
    return sizes.join(ends, "file", "left").select("file", at.alias("at"), (F.col("size") - at).alias("lost")).where("lost <> 0")


def base32(digests: pd.Series) -> pd.Series:
    return digests.map(lambda x: x and base64.b32encode(bytes.fromhex(x)).decode())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select(
        F.col("page").alias("page_id"), F.col("length").alias("payload_bytes"), F.pandas_udf(base32, StringType())("sha1").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"), "sound",
    )
