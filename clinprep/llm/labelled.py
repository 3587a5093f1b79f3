"""Bounded samples of labelled documents, and folds by the CRC-32 of an id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.text import small_batches

#: Labelled documents of each class that a model is fitted on, at most. They are the ones whose
#: ids hash lowest, so the sample does not depend on the order or the partitions of the table.
SAMPLE_PER_CLASS = 1_500
#: Longer labelled texts are not trained on (they are scored whole like any other), so a sample holds at most
#: 2 * SAMPLE_PER_CLASS * TEXT_BYTES bytes.
TEXT_BYTES = 128 << 10


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    """Whether crc32(id as text) mod folds is ``fold``; a null id is never held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, id_col: str = "doc_id", text_col: str = "text", per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], np.ndarray]:
    """Whole texts and 0/1 labels of the sample: per_class documents of each class at most, of TEXT_BYTES at most each.

    Of rows that repeat an id one takes part, of labels that repeat an id the smallest.
    """
    rows = labels.filter(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).groupBy("_id").agg(F.min("_label").alias("_label"))
    rows = rows.withColumn("_order", F.xxhash64("_id"))
    parts = [rows.filter(F.col("_label") == y).orderBy("_order", "_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # 2 x per_class ids
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    fit = texts.filter(F.octet_length("_text") <= TEXT_BYTES).join(picked, F.col("_doc") == F.col("_id"))
    found = sorted(fit.groupBy("_order", "_id", "_label").agg(F.min("_text").alias("_text")).drop("_id").collect())
    return [r["_text"] for r in found], np.array([r["_label"] for r in found], np.int64)


def score_texts(docs: DataFrame, text_col: str, score, out: list[T.StructField], rows: int = 512) -> DataFrame:
    """``docs`` with the columns that ``score(list of texts)`` gives as lists, one for each of ``out``; null texts are ''."""
    small_batches(docs.sparkSession)
    names = [f.name for f in out]
    schema = T.StructType([*[f for f in docs.schema.fields if f.name not in names], *out])
    kept = docs.drop(*names)
    at = kept.columns.index(text_col)
    arrow = [_arrow(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, rows):
                batch = whole.slice(lo, rows)
                values = score([t or "" for t in batch.column(at).to_pylist()])
                arrays = [pa.array(v, k) for v, k in zip(values, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
