"""Keepsake: Spark-native analytics for large photo libraries and text corpora."""
