"""Emptiness, and tables too large to broadcast whatever their files weigh.

Which side of another join is broadcast is left to Spark: by bytes, statically or at run time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)


def grows(df: DataFrame) -> DataFrame:
    """`df` marked as one that grows with the pixels: joins with it sort both sides and broadcast neither.

    Spark judges a table that `cut` wrote by its files, where keys and counters shrink to a few
    bytes a row: what is under the limit there can fill the driver once it is a hash table.
    """
    return df.hint("merge")
