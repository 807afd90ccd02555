"""Tamarack: Spark jobs for retrieval-first ranking, its evaluation and its study tables."""
