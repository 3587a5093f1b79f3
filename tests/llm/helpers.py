"""Small documents with every awkward case, and rows as plain tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, norm int, rank int, node string, length string, component_id string"
LONG = "the quick brown fox jumps over the lazy dog and runs away again " * 400

TEXTS = [
    (0, "Hello  World, this is a shared line of text\nshort\nHELLO WORLD and more words here to read"),
    (1, "Hello World, this is a shared line of text \nanother line that only one document holds"),
    (2, "  hello  world, THIS is a shared line of text\r\nshort\n\n\n"),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, LONG),
    (7, LONG + "tail"),
    (8, "naïve café — ßtraße Ünïcödé 東京 😀 it's we'll 12345\x1cx\x85y"),
    (9, "Hello World,this is a shared line of text\nanotherlinethat only one document holds"),
    (10, "x"),
    (11, "one two three"),
    (11, "one two three"),
    (None, "an orphan without any id says hello to the world"),
    (12, "Hello World, this is a shared line of text\nfour times now"),
]


def documents(spark: SparkSession, rows=None, parts: int = 3) -> DataFrame:
    """The texts with further columns whose names clash with the operators' own."""
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, None, "k", "s", 1, 2, "n", "l", "c") for i, t in rows], SCHEMA).repartition(parts)


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
