"""Spark-native analytics over tagged map features, tile archives and text corpora."""
