"""Deterministic text retrieval and evidence analytics as PySpark DataFrame pipelines."""
