"""Operators for training-data pipelines: text, media, web pages and token files as Spark jobs."""
