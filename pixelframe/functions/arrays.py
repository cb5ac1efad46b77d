"""Array expressions on bands, logits, probabilities and vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UNLABELED


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def total(values) -> Column:
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, v: acc + v)


def is_valid(bands, nodata) -> Column:
    """True iff every band differs from nodata (a NaN nodata matches NaN pixels)."""
    marker = nodata if isinstance(nodata, Column) else F.lit(float(nodata))
    return F.coalesce(F.forall(_col(bands), lambda b: b != marker), F.lit(False))


def softmax(logits) -> Column:
    z = _col(logits)
    top = F.array_max(z)
    weights = F.transform(z, lambda v: F.exp(v - top))
    # One-element transform binds the exponentials once for both the sum and the division.
    bound = F.transform(F.array(weights), lambda e: F.transform(e, lambda v: v / total(e)))
    return F.get(bound, F.lit(0))


def argmax(values) -> Column:
    """Index of the largest element; the first one wins a tie."""
    v = _col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def class_map(probs, valid) -> Column:
    return F.when(_col(valid), argmax(probs)).otherwise(F.lit(UNLABELED)).cast("int")


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda p, q: p * q))


def norm(vec) -> Column:
    return F.sqrt(total(F.transform(_col(vec), lambda v: v * v)))


def rms_difference(a, b) -> Column:
    a, b = _col(a), _col(b)
    squares = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(total(squares) / F.size(a))


def mean_square_difference(a, b) -> Column:
    a, b = _col(a), _col(b)
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q))) / F.size(a)


def byte_scale(value) -> Column:
    """8-bit value by truncation."""
    return (_col(value) * 255).cast("int")


def ordered_values(index, value) -> Column:
    """Aggregate (index, value) rows into an array in index order."""
    pairs = F.array_sort(F.collect_list(F.struct(_col(index).alias("i"), _col(value).alias("v"))))
    return F.transform(pairs, lambda p: p["v"])
