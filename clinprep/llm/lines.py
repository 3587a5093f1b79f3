"""Line dedup over levelled sorted runs of line hashes.

The seen lines live in runs: tables of (line hash, documents, last document), hashed into buckets and
sorted by hash. Each batch of documents is aggregated to its distinct lines, merge-anti-joined
with every run (run and batch share the bucketing, so no run is shuffled), and appended as a run of its own:
lines that no run holds bring the document that keeps them, known lines only add their counts. When a
level holds FANOUT runs they are compacted into one run of the next level, so a batch meets a
number of runs that grows with the logarithm of the batches. Batches go from the largest ids down; thus the
first document to bring a line is the one that keeps it. Only texts that lose a line are shuffled to meet their lines, unless
the ids of those are too many to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import BROADCAST_BYTES, SPACE, ascii_lower, digest128, small_batches, table
from clinprep.sources.shared import shuffle_partitions, store, store_bucketed

BATCHES = 4
FANOUT = 3
#: Bytes that the id of a document takes in a broadcast table, at most.
ID_BYTES = 64


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


class LineRuns:
    """The runs, by level. A run's rows: line (16 bytes), n_docs, keeper (null if an older run has it)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[tuple[DataFrame, str]]] = []  # a run: its bucketed table and its folder

    def add(self, seen: DataFrame) -> None:
        """Append a batch of rows (line, doc_id), one for each document and distinct line."""
        batch = seen.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        run = store_bucketed(batch.repartition(self.buckets, "line"), "line_run", "line", self.buckets)
        if self.levels:
            batch, older = run[0], [table.select("line") for level in self.levels for table, _ in level]
            fresh = reduce(lambda b, lines: b.join(lines, "line", "left_anti"), older, batch)
            known = batch.select("line", "n_docs").join(fresh.select("line", "keeper"), "line", "left")
            run = store_bucketed(known, "line_run", "line", self.buckets)
        self._push(run, 0)

    def _push(self, run: tuple[DataFrame, str], level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level]).repartition(self.buckets, "line")
            self.levels[level] = []
            self._push(store_bucketed(merged, "line_run", "line", self.buckets), level + 1)

    def _merge(self, runs: list[tuple[DataFrame, str]]) -> DataFrame:
        # One plain scan of the folders: Spark 4.1 takes a union of bucketed tables for bucketed, then reads it unbucketed.
        rows = self.spark.read.schema(runs[0][0].schema).parquet(*[path for _, path in runs])
        return rows.groupBy("line").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def merged(self) -> DataFrame:
        return self._merge([run for level in self.levels for run in level])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    r"""One row per input row: ``doc_id, n_lines, n_dropped, kept_text``.

    Texts are split at \n; a null or empty text is one empty line. A line whose stripped, lower-cased key has
    min_chars code points or more and stands in min_docs rows or more is dropped from all but the row with
    the largest id that holds it. Each row is a document: repeated rows count as often as they stand, and
    rows that share the largest id all keep the line. A null id is smaller than any other. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = F.transform(F.split("text", "\n", -1), line_key)
    long_keys = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), digest128))
    span = base.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    width = (hi - lo) // batches + 1
    batch = F.coalesce(F.floor((F.lit(hi) - F.col("doc_id")) / F.lit(width)), F.lit(batches - 1)).cast("int")
    seen = base.select("doc_id", batch.alias("batch"), F.explode(long_keys).alias("line"))
    seen = store(seen, "lines", partition_by="batch")
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(seen.filter(F.col("batch") == b).select("line", "doc_id"))
    drop = store(runs.merged().filter(F.col("n_docs") >= min_docs).select(F.col("line").alias("d_line"), "keeper"), "line-drops")
    hits = seen.join(drop, seen["line"] == drop["d_line"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    marks = store(hits.groupBy(F.col("doc_id").alias("m_doc")).agg(F.collect_set("line").alias("drops")), "line-marks")
    same = base["doc_id"].eqNullSafe(marks["m_doc"])
    lines = F.split("text", "\n", -1)
    count = F.size(lines).cast("long").alias("n_lines")
    if (n := marks.count()) * ID_BYTES > BROADCAST_BYTES:
        return _without(base.join(marks.hint("merge"), same, "left"))
    # texts without a line to drop stay where they are
    ids = F.broadcast(marks.select(F.col("m_doc").alias("t_doc")))  # n ids
    touched = base["doc_id"].eqNullSafe(ids["t_doc"])
    rest = base.join(ids, touched, "left_anti").select("doc_id", count, F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    # a merge at any size, so that the plan of a small table is that of a large one
    return _without(base.join(ids, touched, "left_semi").join(marks.hint("merge"), same)).unionByName(rest) if n else rest


def _without(marked: DataFrame) -> DataFrame:
    """The lines of each text but those whose digest is in ``drops``; digests come from built-in functions."""
    lines = F.split("text", "\n", -1)
    ready = marked.select("doc_id", lines.alias("lines"), F.transform(lines, lambda x: digest128(line_key(x))).alias("digests"), "drops")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, dropped, kept = [], [], []
            for whole, digests, drops in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                gone = frozenset(drops or ())
                stays = [x for x, d in zip(whole, digests, strict=True) if d not in gone]
                total.append(len(whole))
                dropped.append(len(whole) - len(stays))
                kept.append("\n".join(stays))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    small_batches(marked.sparkSession)
    return ready.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``documents``.

    Null and empty texts are one empty line; lines under 20 code points always stay; rows that share the largest id of a line
    all keep it; an empty table gives no rows.
    """
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), m AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3
), f AS (
  SELECT k.*, m.key IS NOT NULL AND k.doc_id IS DISTINCT FROM m.keeper AS dropped FROM k LEFT JOIN m ON k.key = m.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
