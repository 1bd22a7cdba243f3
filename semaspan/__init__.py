"""Distributional semantics over large tagged corpora, as PySpark DataFrame jobs."""
