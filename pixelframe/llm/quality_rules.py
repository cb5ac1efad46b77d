"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Every text becomes a vector of transformed statistics. For each language and source the minimum
covariance determinant estimate of centre and scatter is found by concentration steps from two
starts (medians, and plain moments), keeping the start with the smaller determinant. Documents
whose Mahalanobis distance exceeds a chi-square cutoff are rejected, beside a fixed base rule.

Vectors are fixed-point integers, so sums are exact and the same in any order; the cut of each
concentration step is an exact percentile of binned distances. Every language and source is
estimated from its own documents, however few; FLOORS keep the scatter of few documents regular.

Null text has no words (and fails the base rule). Null language or source is a group of its own.
A row is judged alone: repeated rows get equal verdicts.
"""

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.llm.common import documents, salted_join, text_key, words
from pixelframe.session import cut

STEPS = 3  # concentration steps from each start
H = 0.75  # share of a group that the estimate rests on
CONSISTENCY = 1.42  # makes the scatter of the inner share that of all, for five dimensions
CUTOFF = 30.86  # squared distance: the 0.99999 quantile of chi-square with five degrees of freedom
SCALE = 1024  # units of a vector's fixed-point values
# Least standard deviation of each statistic: below these a difference says nothing of quality.
FLOORS = {"length": 0.5, "word": 0.5, "marks": 0.1, "upper": 0.1, "repeats": 0.25}
DIMS = list(FLOORS)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, shares)."""
    text = F.coalesce("text", F.lit(""))
    at = F.expr("sequence(0, size(ws) - 3)")
    hashed = F.when(
        F.size("ws") >= 3,
        F.transform(at, lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    # Equal neighbours of the sorted hashes are windows found twice; their places follow from a sort
    # of (hash, place), taken only where there is such a window at all.
    placed = F.sort_array(F.transform("hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = F.filter("st", lambda x, i: (x["h"] == F.get("st", i - 1)["h"]) | (x["h"] == F.get("st", i + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(
        F.transform("tw", lambda x: x["i"]), lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \t\x0b\x0c\r]"))
    letters = F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = F.char_length(F.translate(text, "!|#*$%&<>^~=_+{}[]\\@", ""))
    return (
        docs.select("doc_id", F.xxhash64("doc_id", text_key()).alias("key"), "lang", "source", "text")
        .withColumn("ws", words(text))
        .withColumn("hs", hashed)
        .withColumn("st", F.when(F.size(F.array_distinct("hs")) < F.size("hs"), placed))
        .withColumn("tw", twice)
        .withColumn("ls", lines)
        .select(
            "doc_id", "key", "lang", "source",
            F.size("ws").cast("long").alias("n_words"),
            F.char_length(F.array_join("ws", "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
            F.coalesce(F.when(F.col("st").isNotNull(), F.size(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
            (F.char_length(text) - letters).cast("long").alias("n_upper"),
            (F.char_length(text) - marks).cast("long").alias("n_marks"),
            F.size("ls").cast("long").alias("n_lines"),
        )
    )


def vectors(stats: DataFrame) -> DataFrame:
    """`stats` with the transformed statistics as fixed-point longs, one column per dimension."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    value = {
        "length": F.log1p("n_words"),
        "word": F.log1p(F.col("word_chars") / n) * 4,
        "marks": F.sqrt(F.col("n_marks") / n),
        "upper": F.sqrt(F.col("n_upper") / chars),
        "repeats": F.sqrt((F.col("n_repeat_words") / n + F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))) / 2),
    }
    return stats.withColumns({k: F.round(v * SCALE).cast("long") for k, v in value.items()})


def factor(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Lower Cholesky factor of a symmetric matrix given by its lower entries, as columns l{i}{j}."""
    out: dict[str, Column] = {}
    for j in range(len(DIMS)):
        diag = cov[j, j] - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out[f"l{j}{j}"] = F.sqrt(F.greatest(diag, F.lit(1.0)))
        for i in range(j + 1, len(DIMS)):
            rest = cov[i, j] - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out[f"l{i}{j}"] = rest / F.col(f"l{j}{j}")
    return out


def estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and factored covariance of `rows` per keys; the least deviations are added to the diagonal."""
    p = range(len(DIMS))
    sums = [F.sum(DIMS[i]).alias(f"s{i}") for i in p]
    prods = [F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for j, i in combinations_with_replacement(p, 2)]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *prods)
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in p})
    cov = {
        (i, j): (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY
        + (F.lit((FLOORS[DIMS[i]] * SCALE) ** 2) if i == j else F.lit(0.0))
        for j, i in combinations_with_replacement(p, 2)
    }
    for name, column in factor(cov).items():
        out = out.withColumn(name, column)
    det = sum((F.log(f"l{i}{i}") for i in p), F.lit(0.0))
    return out.select(*keys, *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)], det.alias("logdet"))


def distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i, name in enumerate(DIMS):
        known = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"y{i}", (F.col(name) - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(len(DIMS))), F.lit(0.0)))


def median_start(rows: DataFrame) -> DataFrame:
    """Centre by medians, diagonal scatter by median absolute deviations."""
    mid = rows.groupBy("grp").agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(DIMS)])
    off = [F.percentile(F.abs(F.col(c) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, c in enumerate(DIMS)]
    mads = salted_join(rows, mid, ["grp"], F.col("key")).groupBy("grp", *[f"m{i}" for i in range(len(DIMS))]).agg(*off)
    scatter = {
        f"l{i}{j}": F.sqrt((F.col(f"a{i}") * 1.4826) ** 2 + (FLOORS[DIMS[i]] * SCALE) ** 2) if i == j else F.lit(0.0)
        for i in range(len(DIMS)) for j in range(i + 1)
    }
    return mads.select("grp", F.lit("median").alias("start"), *[f"m{i}" for i in range(len(DIMS))],
                       *[v.alias(k) for k, v in scatter.items()], F.lit(0.0).alias("logdet"))


def keyed_by_start(estimates: DataFrame) -> DataFrame:
    """(grp, starts): the estimates of each group, one per start, as an array."""
    rest = [c for c in estimates.columns if c not in ("grp", "logdet")]
    return estimates.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("starts"))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The minimum covariance determinant estimate of each group of `rows` (grp and DIMS)."""
    plain = estimate(rows, ["grp"]).withColumn("start", F.lit("moments"))
    current = cut(median_start(rows).unionByName(plain.select("grp", "start", *[c for c in plain.columns if c not in ("grp", "start")])))
    for _ in range(STEPS):
        far = distance(salted_join(rows, keyed_by_start(current), ["grp"], F.col("key")).select("*", F.inline("starts")).drop("starts"))
        binned = far.withColumn("bin", F.floor(F.log1p("d2") * 64)).select("grp", "start", "bin", "key", *DIMS)
        inner = binned.groupBy("grp", "start").agg(F.percentile("bin", F.lit(H)).alias("most"))
        current = cut(estimate(salted_join(binned, inner, ["grp", "start"], F.col("key")).where("bin <= most"), ["grp", "start"]))
    best = current.groupBy("grp").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    return current.join(best, ["grp", "start"]).drop("start", "logdet")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every row of `docs`."""
    # JSON tells nulls from any text, and where one name ends.
    stats = vectors(statistics(docs)).withColumn("grp", F.to_json(F.struct("lang", "source")))
    rows = cut(stats)
    estimates = robust_estimates(rows.select("grp", "key", *DIMS))
    judged = distance(salted_join(rows, estimates, ["grp"], F.col("key")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("d2") <= CUTOFF)).alias("kept"), F.col("d2").alias("distance"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
