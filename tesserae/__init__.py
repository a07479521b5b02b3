"""Spark-native asset-catalogue, configuration, mesh and raster analytics."""
