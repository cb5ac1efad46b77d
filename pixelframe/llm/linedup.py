"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed; the first occurrence of a window in
(doc_id, line) order stays, and every line that a later occurrence covers goes. Windows are judged
on the input, so a line may go that belongs to the first occurrence of another window.

Null text stays null, with no lines. A text of fewer than three lines has no window. Windows of
three blank lines do not count. Rows without a doc_id are returned as they are and take no part.
Repeated rows share their place in the order: each is kept as its twin is. Rows that share a doc_id but not
the text are judged each by its own lines.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import documents, text_key

SALT = 16  # a window that a third of all documents share is joined in this many parts


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_at, pos, h1, h2): two 64-bit hashes of lines pos, pos+1, pos+2; text_at tells a doc_id's texts apart."""
    lines = F.split("text", "\n", -1)
    at = F.transform(
        F.expr("sequence(0, size(ls) - 3)"),
        lambda i: F.struct(
            i.alias("pos"),
            F.xxhash64(F.get("ls", i), F.get("ls", i + 1), F.get("ls", i + 2)).alias("h1"),
            F.xxhash64(F.lit(7), F.get("ls", i + 2), F.get("ls", i), F.get("ls", i + 1)).alias("h2"),
            (F.concat(F.get("ls", i), F.get("ls", i + 1), F.get("ls", i + 2)).rlike("[^ \t\r]")).alias("full"),
        ),
    )
    return (
        docs.where("doc_id is not null and text is not null")
        .select("doc_id", text_key().alias("text_at"), lines.alias("ls"))
        .where("size(ls) >= 3")
        .select("doc_id", "text_at", F.explode(at).alias("w"))
        .where("w.full")
        .select("doc_id", "text_at", "w.pos", "w.h1", "w.h2")
    )


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_at, at): per text of a document the starts of windows that occurred before."""
    each = windows(docs)
    firsts = (
        each.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max(F.struct("doc_id", "pos")).alias("last"))
        .where("first < last")
        .select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    )
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALT)).cast("int"))
    return (
        salted.join(firsts, ["h1", "h2", "salt"])
        .where(F.struct("doc_id", "pos") > F.col("first"))
        .groupBy("doc_id", "text_at")
        .agg(F.collect_set("pos").alias("at"))
    )


def marked(docs: DataFrame) -> DataFrame:
    """(row, n_lines, n_removed, kept_text): each row of `docs` as a struct with what is left of its text."""
    covered = F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(p, p + 1, p + 2))))
    kept = F.expr("array_except(sequence(0, n_lines - 1), covered)")
    return (
        docs.select(F.struct("*").alias("row"))
        .join(later_windows(docs), (F.col("row.doc_id") == F.col("doc_id")) & (text_key("row.text") == F.col("text_at")), "left")
        .withColumn("ls", F.split("row.text", "\n", -1))
        .withColumn("n_lines", F.when(F.col("row.text").isNull(), 0).otherwise(F.size("ls")))
        .withColumn("covered", covered)
        .select(
            "row",
            F.col("n_lines").cast("long").alias("n_lines"),
            F.when(F.col("at").isNull() | F.col("row.text").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
            F.when(F.col("at").isNull() | F.col("row.text").isNull(), F.col("row.text"))
            .otherwise(F.array_join(F.transform(kept, lambda i: F.get("ls", i)), "\n"))
            .alias("kept_text"),
        )
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text), a row for each row of `docs`."""
    return marked(docs).select("row.doc_id", "n_lines", "n_removed", "kept_text")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the remaining lines as text, and n_chars counted anew where there is such a column."""
    left = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return marked(docs).select(*[left.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


ORACLE = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, pos, ls[pos + 1] as a, ls[pos + 2] as b, ls[pos + 3] as c
      from (select doc_id, ls, unnest(range(0, len(ls) - 2)) as pos from l where len(ls) >= 3)),
r as (select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as k
      from w where regexp_matches(a || b || c, '[^ \\t\\r]')),
gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as i from r where k > 1),
lines as (select doc_id, unnest(range(0, len(ls))) as i, unnest(ls) as line from l),
kept as (select doc_id, string_agg(line, chr(10) order by i) as kept_text
         from lines anti join gone using (doc_id, i) group by doc_id),
lost as (select doc_id, count(*) as n_removed from gone group by doc_id)
select l.doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines,
       cast(coalesce(n_removed, 0) as bigint) as n_removed,
       case when l.text is null then null else coalesce(kept_text, '') end as kept_text
from l left join kept using (doc_id) left join lost using (doc_id)
"""
