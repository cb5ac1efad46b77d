"""Imports every registering module; `FLAGSHIP` is the per-scene accuracy report."""

from . import q_evaluate, q_labels, q_pixels, q_runs, q_select, q_tiles  # noqa: F401
from .common import scored


def FLAGSHIP(spark, sf):
    return scored(spark, sf)
