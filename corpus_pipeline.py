"""A training corpus from raw documents: five stages, each a written table that the next one reads.

Stages 1 and 2 fit their models on labelled documents of the tables in ``sf_dir`` (a bounded sample, see
clinprep.llm.labelled) and score every document that is left; a document is rejected if its score is on the bad side
of REJECT. Stage 3 keeps one of equal texts, stage 4 one of each group of near copies, stage 5 packs what is left.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm import exact, jaccard, packing, quality, toxicity
from clinprep.llm.text import table
from clinprep.sources.shared import scratch, store

#: Documents below this quality, or at or above this toxicity, go.
REJECT_QUALITY, REJECT_TOXICITY = 0.5, 0.7

#: Near copies: a Jaccard similarity of 0.8 or more of the sets of five-word shingles (see clinprep.llm.jaccard).
NEAR_WORDS = 5


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality, judged by a model trained on the labelled documents of ``sf_dir``.

    Null texts are scored as empty; repeated rows get the same score and stay or go together; without labels of both classes
    the score is the share of good labels, or one half, so all stay or all go. An empty table stays empty.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return _filtered(docs, lambda d: quality.quality(d, model), F.col("score") >= REJECT_QUALITY)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects toxic documents, judged by a model trained on the labelled documents of ``sf_dir``; cases as in keep_good."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return _filtered(docs, lambda d: toxicity.toxicity(d, model), F.col("score") < REJECT_TOXICITY)


def _filtered(docs: DataFrame, score, keeps) -> DataFrame:
    """``docs`` where the score keeps them. Columns go by number meanwhile, so any further column may be there."""
    names = docs.columns
    numbered = docs.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(names)])
    return score(numbered).filter(keeps).select(*numbered.columns).toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts stays: the longest original, then the smallest doc_id, then the row that hashes lowest.

    Null and empty texts, and those of white space only, are one group; null ids come last, repeated ids are rows like any others.
    """
    return exact.drop_exact_copies(docs, weight=F.length)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies stays.

    MinHash bands propose pairs, pigeonring filtering of SimHash fingerprints prunes them, the sets of shingles decide. A document
    without an id stays; rows that repeat an id are one document, and stay or go together. Texts without words are near
    copies of one another; an empty table stays empty.
    """
    found = jaccard.near_copies(docs, words=NEAR_WORDS)
    gone = found.filter(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def pack_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left and their places in sequences of 4096 tokens; null and empty texts hold the end token only.

    Pieces of equal length and repeated rows have places of their own; an empty table gives no rows.
    """
    return packing.packed_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_rest),
]

#: Trained models and fingerprints are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus, with their places: STAGES applied to ``documents`` one after another.

    Each stage's result is a written table that the next one reads; what a stage wrote on its way is dropped once its
    result is there. Nulls, empty texts, ties, repeated rows and further columns are each stage's affair; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
