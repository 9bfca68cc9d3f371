"""Layered raster analytics and text-corpus processing on Spark."""
