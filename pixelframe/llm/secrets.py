"""Secret scans judged by corpus-wide ownership, in DataFrame functions only.

Patterns give candidates with their places, all kinds in one scan. Each candidate's value is hashed and the hashes
are counted over the whole corpus: in how many repositories (here distinct texts: copies of a document are one
repository) and by how many owners (here sources; a text that several sources hold is its least source's). A value
in COPIED_REPOS repositories or of COPIED_BY owners is a widely copied example; any other that also looks random is
live-looking. Spans of the base kinds always stay; the further kinds enter only where ownership says that they are
live-looking.

Null text counts as empty. Places are code points, end exclusive. Repeated rows get equal results;
a value repeated in one document counts once. A null source is an owner of its own.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pixelframe.llm.common import documents, text_key
from pixelframe.session import cut

# kind, pattern, group that holds the value, least characters of it. Runs of a greedy class are
# maximal, so for access and hex the least length can stand in the pattern.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
FURTHER = [
    ("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{20,})", 1, 20),
    ("upper", r"[0-9A-F]{24,}", 0, 24),
]
COPIED_BY, COPIED_REPOS = 2, 8  # owners, or repositories, from which on a value counts as a copied example
HIT = "array<struct<ord:int,kind:string,gap:int,len:int,ok:boolean,value:string>>"


def found(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of one kind as (ord, kind, gap, len, ok, value); gap: characters since the one before."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    each = F.zip_with(
        F.arrays_zip(whole.alias("m"), value.alias("v")),
        F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
        lambda m, g: F.struct(
            F.lit(order).alias("ord"), F.lit(kind).alias("kind"),
            F.char_length(g).alias("gap"), F.char_length(m["m"]).alias("len"),
            (F.char_length(m["v"]) >= least).alias("ok"), m["v"].alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), each.cast(HIT)).otherwise(F.array().cast(HIT))


def candidates(docs: DataFrame, owner: str) -> DataFrame:
    """(doc_id, key, owner, ord, kind, start, end, value) of matches that are long enough."""
    matches = F.concat(*[found(F.col("text"), n, *kind) for n, kind in enumerate([*BASE, *FURTHER])])
    before = W.partitionBy("doc_id", "key", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return (
        docs.where("text is not null")
        .select("doc_id", text_key().alias("key"), F.col(owner).alias("owner"), F.posexplode(matches).alias("i", "hit"))
        .select("doc_id", "key", "owner", "i", "hit.*")
        .groupBy("doc_id", "key", "ord", "i")
        .agg(F.min("owner").alias("owner"), *[F.first(c).alias(c) for c in ("kind", "gap", "len", "ok", "value")])
        .withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0)) + F.col("gap"))
        .where("ok")
        .select("doc_id", "key", "owner", "ord", "kind", "start", (F.col("start") + F.col("len")).alias("end"), "value")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(fingerprint, n_repos, n_owners) of every value: distinct counts in steps, each combined map-side."""
    return (
        found.groupBy("fingerprint", "key").agg(F.min("owner").alias("owner"), F.lit(1).alias("n"))
        .groupBy("fingerprint", "owner").agg(F.sum("n").alias("n"))
        .groupBy("fingerprint").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    )


def looks_random(value: Column) -> Column:
    """Eight characters or more, of two kinds at least, and no word that marks a sample."""
    mixed = sum(value.rlike(p).cast("int") for p in ("[0-9]", "[a-z]", "[A-Z]"))
    return (F.char_length(value) >= 8) & (mixed >= 2) & ~F.lower(value).rlike("example|sample|changeme|dummy|xxxx|1234567")


def scan(docs: DataFrame, owner: str = "source", copied_by: int = COPIED_BY, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """A row per row of `docs`: counts and places of base kinds, all spans, n_live, n_copied, most_repos, most_owners.

    most_repos and most_owners are the greatest counts among a document's values.
    """
    docs = docs.select("doc_id", "text", F.col(owner).alias("owner"))
    hits = cut(candidates(docs, "owner").withColumn("fingerprint", F.sha2(F.encode("value", "UTF-8"), 256)))
    owned = ownership(hits).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    judged = (
        hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(16)).cast("int"))
        .join(owned.hint("merge"), ["fingerprint", "salt"])  # grows with the corpus: never broadcast
        .withColumn("copied", (F.col("n_owners") >= copied_by) | (F.col("n_repos") >= copied_repos))
        .withColumn("live", ~F.col("copied") & looks_random(F.col("value")))
    )
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    span = F.struct(F.col("start").cast("long").alias("start"), "ord", "kind", F.col("end").cast("long").alias("end"))
    per_doc = judged.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sort_array(F.collect_list(F.when((F.col("ord") < len(BASE)) | F.col("live"), span))).alias("all"),
        F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"),
        F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners"),
    )
    base = F.array_join(F.transform(F.filter("all", lambda x: x["ord"] < len(BASE)), said), ",")
    counted = [f"n_{kind}" for kind, *_ in BASE]
    return (
        docs.select("doc_id", text_key().alias("key"))
        .join(per_doc.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
        .select(
            "doc_id",
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted],
            F.sha2(F.encode(F.coalesce(base, F.lit("")), "UTF-8"), 256).alias("base_sha256"),
            F.coalesce(F.array_join(F.transform("all", said), ","), F.lit("")).alias("spans"),
            *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_copied", "most_repos", "most_owners")],
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
