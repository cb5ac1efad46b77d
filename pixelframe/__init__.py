"""Raster labelling, scoring and evaluation as DataFrame -> DataFrame jobs on Spark."""
