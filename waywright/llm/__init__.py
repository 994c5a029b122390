"""Operators for large-scale training-data pipelines, all running as Spark jobs."""
