"""Stable pseudo-random numbers that depend on keys only, never on partitioning."""

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A polynomial hash of integer keys modulo a prime, with one squaring against linear structure and
# two rounds modulo different primes. Plain bigint arithmetic: it stays in generated code, and any
# SQL engine can repeat it.
PRIME, SECOND_PRIME = 2147483647, 2147483629
MULTIPLIER, SECOND_MULTIPLIER = 1583458089, 784588716
FIRST_STIR, STIR = 1013904223, 12345


def mixed(*parts) -> Column:
    """An integer in [0, PRIME) from non-negative integer keys.

    Leading Python integers (seed, epoch, purpose) are folded and squared on the driver; the
    columns follow, and the result of at least one of them is required.
    """
    head, parts = 1, list(parts)
    while parts and not isinstance(parts[0], Column):
        head = (head * MULTIPLIER + int(parts.pop(0)) + 1) % PRIME
        head = (head * head + FIRST_STIR) % PRIME
    h = F.lit(head).cast("bigint")
    for part in parts:
        value = part if isinstance(part, Column) else F.lit(int(part))
        h = (h * MULTIPLIER + value.cast("bigint") + 1) % PRIME
    h = (h * h + STIR) % PRIME
    h = (h * SECOND_MULTIPLIER + 1) % SECOND_PRIME
    return (h * MULTIPLIER + 1) % PRIME


def uniform(*parts) -> Column:
    """A number in [0, 1) from integer keys."""
    return mixed(*parts).cast("double") / float(PRIME)


def between(low: float, high: float, *parts) -> Column:
    return F.lit(low) + uniform(*parts) * (high - low)


def integer_below(bound, *parts) -> Column:
    """An integer in [0, bound)."""
    bound = bound if isinstance(bound, Column) else F.lit(bound)
    return F.floor(uniform(*parts) * bound).cast("int")


@F.pandas_udf(T.StringType())
def blake2b_hex(names: pd.Series) -> pd.Series:
    """Eight-byte BLAKE2b digest as hex; hex order equals the order of the rank in [0, 1)."""
    return names.map(lambda n: hashlib.blake2b(n.encode("utf-8"), digest_size=8).hexdigest())
