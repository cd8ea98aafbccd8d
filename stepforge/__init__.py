"""Spark-first engine for episode data: curation, splits, audits, retrieval and metrics."""
