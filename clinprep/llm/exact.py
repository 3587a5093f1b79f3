"""Exact dedup: 128-bit content hash, bytes compared inside groups, one row of each group stays.

Only DataFrame functions run. One scan writes a narrow table of hashes; rows are grouped by it. Normalised texts move only
for hashes that several rows have, and distinct ones only, so a text that holds a third of all rows leaves each map
task once. Where the bytes under one hash differ, its group is split by a second digest. Rows then meet the groups of several
rows, which are written and broadcast if they are few; if not, adaptive execution splits the rows of a hot group over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import digest128, small_side, table, without_space
from clinprep.sources.shared import store

KEY = ["hash", "part"]
#: Bytes of a row of groups in memory, at most.
GROUP_BYTES = 128


def _rows(docs: DataFrame, id_col: str, text_col: str, normalise, weight, digest, *carried: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (weight(text) if weight else F.lit(0)).cast("long").alias("weight"), normalise(text).alias("norm"), *carried)
    return rows.withColumn("hash", digest(F.col("norm")))


def _parted(rows: DataFrame, collided: DataFrame) -> DataFrame:
    """``rows`` with ``part``: what tells texts of one hash apart, empty for hashes that one text has."""
    split = F.when(F.col("collided"), F.unhex("sha")).otherwise(F.lit(b""))
    return rows.join(small_side(collided, 64), "hash", "left").withColumn("part", split).drop("collided")


def _groups(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of two or more rows, and the hashes that different texts have. keys: doc_id, weight, hash, sha, row of ``rows``."""
    repeated = store(keys.groupBy("hash").count().filter("count > 1").select("hash"), "repeated-hashes")
    texts = rows.join(small_side(repeated, 64), "hash", "left_semi").select("hash", "norm").distinct()
    collided = store(texts.groupBy("hash").count().filter("count > 1").select("hash", F.lit(True).alias("collided")), "collided-hashes")
    same = _parted(keys, collided).groupBy(*KEY, "weight", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    best = F.max(F.struct("weight", F.bitwise_not("doc_id").alias("last"), "n", "row")).alias("best")
    found = same.groupBy(*KEY).agg(F.sum("n").alias("group_size"), best).filter("group_size > 1")
    named = found.select(*[F.col(k).alias(f"g_{k}") for k in KEY], "group_size", F.col("best.weight").alias("keep_weight"), F.bitwise_not("best.last").alias("keep_id"), F.col("best.n").alias("ties"), F.col("best.row").alias("keep_row"))
    return store(named, "exact-groups"), collided


def _grouped(rows: DataFrame, groups: DataFrame, collided: DataFrame) -> DataFrame:
    same = [F.col(k) == F.col(f"g_{k}") for k in KEY]
    return _parted(rows, collided).join(small_side(groups, GROUP_BYTES), same[0] & same[1], "left")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_space,
    weight: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = digest128,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts the row with the largest ``weight`` of its original text stays (none:
    all equal), then the smallest id. A null text counts as empty; empty texts form one group. A null
    id sorts after every other id. Of rows that repeat the id and weight of the row that stays, one is kept, so
    that every group keeps exactly one row; each counts in ``group_size``. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col, normalise, weight, digest)
    keys = store(rows.select("doc_id", "weight", "hash", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("row")), "exact-keys")
    found = _grouped(keys, *_groups(rows, keys))
    alone = F.col("g_hash").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_space,
    weight: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = digest128,
) -> DataFrame:
    """One document of each group of exact_groups, with all its columns; texts outside groups pass without a shuffle.

    Of several rows with the id and the weight of the one that stays, the row whose columns hash lowest stays.
    """
    whole = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns)]).alias("whole")
    rows = _rows(docs, id_col, text_col, normalise, weight, digest, whole)
    keys = rows.select("doc_id", "weight", "hash", F.sha2("norm", 256).alias("sha"), F.lit(0).cast("long").alias("row"))
    keys = store(keys, "exact-keys")
    groups, collided = _groups(rows, keys)
    joined = _grouped(rows.withColumn("sha", F.sha2("norm", 256)), groups, collided)
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("weight") == F.col("keep_weight"))
    kept = joined.filter(F.col("g_hash").isNull() | (best & (F.col("ties") == 1))).select("whole")
    if not groups.filter("ties > 1").isEmpty():
        hashed = [F.col(f"whole._{i}") for i, (_, kind) in enumerate(docs.dtypes) if "map<" not in kind and "variant" not in kind]
        tied = joined.filter(best & (F.col("ties") > 1)).groupBy(*KEY).agg(F.min_by("whole", F.xxhash64(*hashed)).alias("whole"))
        kept = kept.unionByName(tied.select("whole"))
    return kept.select("whole.*").toDF(*docs.columns)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``documents``; the longest original stays.

    Null texts are empty and one group with all that is white space only; one row of each group is kept, also where ids
    repeat or are null. An empty table gives no rows.
    """
    return exact_groups(table(spark, sf_dir, "documents"), weight=F.length)


#: DuckDB's own view of the same rows.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-cp, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
