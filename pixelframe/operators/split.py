"""Deterministic training / validation membership, computed from scene names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import blake2b_hex
from ..plans.ordered import take_lowest
from ..schema import ROLES, VALIDATION_RATIO

PREFIX = 4


def split_rank(name: str = "name", algo: str = "blake2b") -> Column:
    """Hex digest whose text order is the split order; depends on the name only.

    The eight-byte BLAKE2b digest by default. `algo="md5"` gives an order that any SQL engine can
    repeat and that needs no Python; a project keeps to one of them.
    """
    if algo == "md5":
        return F.md5(F.col(name))
    if algo == "blake2b":
        return blake2b_hex(F.col(name))
    raise ValueError(f"Unknown rank: {algo}")


def base_validation(
    names: DataFrame,
    ratio: float = VALIDATION_RATIO,
    algo: str = "blake2b",
    project: str | None = None,
) -> DataFrame:
    """The int(ratio * N) lowest-ranked names of each project.

    Names are unique per project. Digest prefixes spread them evenly, so only the prefix at the cut is ranked, however
    many names one project has.
    """
    keyed = names if project else names.withColumn("_project", F.lit(0))
    key = project or "_project"
    ranked = keyed.select(key, "name").withColumn("rank", split_rank("name", algo))
    share = F.floor(F.lit(float(ratio)).cast("double") * F.col("group_rows"))
    low = take_lowest(
        ranked, [key], F.substring("rank", 1, PREFIX), [F.col("rank"), F.col("name")], share
    )
    return low if project else low.drop("_project")


def effective_split(
    names: DataFrame,
    overrides: DataFrame,
    ratio: float = VALIDATION_RATIO,
    algo: str = "blake2b",
    project: str | None = None,
) -> DataFrame:
    """`role` of every name: the base split with overrides on top.

    Overrides for absent names fall out of the left joins.
    """
    keys = [project, "name"] if project else ["name"]
    base = base_validation(names, ratio, algo, project).select(
        *keys, F.lit("validation").alias("base_role")
    )
    chosen = overrides.select(*keys, F.col("role").alias("override_role"))
    chosen = chosen.filter(F.col("override_role").isin(*ROLES))
    return (
        names.select(*keys)
        .join(base, keys, "left")
        .join(chosen, keys, "left")
        .select(*keys, F.coalesce("override_role", "base_role", F.lit("training")).alias("role"))
    )


def set_role(
    names: DataFrame,
    overrides: DataFrame,
    wanted: DataFrame,
    ratio: float = VALIDATION_RATIO,
    algo: str = "blake2b",
) -> DataFrame:
    """Overrides after moving `wanted(name, role)`; only real deviations from the base stay.

    Names the project does not have are ignored.
    """
    bad = wanted.filter(~F.col("role").isin(*ROLES)).select("role").take(1)
    if bad:
        raise ValueError(f"Unknown role: {bad[0]['role']}")
    known = wanted.join(names.select("name"), "name", "left_semi")
    base = base_validation(names, ratio, algo).select(
        "name", F.lit("validation").alias("base_role")
    )
    moved = (
        known.join(base, "name", "left")
        .filter(F.col("role") != F.coalesce("base_role", F.lit("training")))
        .select("name", "role")
    )
    return overrides.join(known, "name", "left_anti").select("name", "role").unionByName(moved)
