"""Spark jobs that clean clinical event tables and prepare large text corpora."""
