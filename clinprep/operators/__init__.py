"""Operators on event tables: DataFrame in, DataFrame out."""
