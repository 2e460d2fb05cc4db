"""Spark-native analytics over tiled raster scenes, seen as tables of pixels, segments and objects."""

__version__ = "0.1.0"
