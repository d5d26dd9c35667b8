"""Foliospark: Spark-first analytics over page rasters, annotations and document corpora."""
