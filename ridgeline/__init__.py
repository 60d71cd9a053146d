"""Spark-native terrain visibility and geospatial analytics."""
