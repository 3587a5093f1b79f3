"""Exact top-k search with block-at-a-time pruning.

Vectors lie in blocks of consecutive ids; a block is a forward index (its rows' values, by dimension)
with the largest and smallest value of each dimension. What a block can score at most for a query is
the sum over dimensions of the query's value times that extreme. A query orders all blocks of the table by this bound,
from the table of extremes alone, and scores its first few whole; its k-th best score so far goes to all tasks. Each
then takes the other blocks in falling order of the bound and scores them whole, until the bound falls below the k-th
best score. The queries go to the blocks, in batches of bounded bytes; only k results a query leave a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinprep.llm.text import small_batches, table
from clinprep.sources.shared import scratch, store, store_observed

BLOCK_ROWS = 256
#: Blocks that a query scores first, blocks of a partition of the index, and bytes of the blocks that a task orders at a time.
FIRST, PART_BLOCKS, HELD_BYTES = 4, 64, 32 << 20
#: Bytes of a batch of queries, which each task holds whole, and what a query counts for at least.
QUERY_BYTES, ONE_QUERY = 32 << 20, 256
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as longs; what leaves 64 bits stays at their ends."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and every component finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products a @ b.T: by floating point for rows where no sum can leave 2^53, else in whole numbers of any size.

    Products that leave 64 bits stay at their ends.
    """
    size = np.abs(a.astype(float)).max(1, initial=0) * np.abs(b.astype(float)).max(initial=0) * a.shape[1]
    exact = size < 2.0**53
    out = np.empty((len(a), len(b)), np.int64)
    out[exact] = np.rint(a[exact].astype(float) @ b.astype(float).T).astype(np.int64)
    if not exact.all():
        whole = np.dot(a[~exact].astype(object), b.T.astype(object))
        out[~exact] = np.clip(whole, LOWEST, HIGHEST).astype(np.int64)
    return out


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No row of a block scores more for a query. In floating point, raised by far more than its errors."""
    q, high, low = (x.astype(float) for x in (q, high, low))
    most = np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T
    reach = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + 1e-9 * most
    return np.maximum(reach, float(LOWEST))  # where scores stay


class Search:
    """The k best of every query so far: by score, ties to the smaller id. A query's own row takes no part.

    floors: a score for each query that k rows elsewhere reach (LOWEST if not); what scores less is left out.
    """

    def __init__(self, rows: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.rows, self.queries, self.k = rows, queries, k
        self.floors = np.full(len(rows), LOWEST) if floors is None else floors
        self.scores, self.ids = (np.zeros((len(rows), k), np.int64) for _ in range(2))
        self.none = np.ones((len(rows), k), bool)
        self.scored = self.met = 0  # blocks, counted once a query

    def kth(self) -> np.ndarray:
        return np.maximum(np.where(self.none[:, -1], LOWEST, self.scores[:, -1]), self.floors).astype(float)

    def take(self, blocks: list[tuple], done: list[np.ndarray]) -> None:
        """Some blocks (high, low, rows, ids, values), each query in its own order; done: the queries that have scored each before."""
        reach = bounds(self.queries, np.stack([b[0] for b in blocks]), np.stack([b[1] for b in blocks]))
        for b, some in enumerate(done):
            reach[some, b] = -np.inf
        order = np.argsort(-reach, axis=1, kind="stable")
        self.met += reach.size
        for at in order.T:
            alive = np.take_along_axis(reach, at[:, None], 1)[:, 0] >= self.kth()  # equal bounds go on: a smaller id may tie
            if not alive.any():
                break
            for b in np.unique(at[alive]):
                self.score(np.flatnonzero(alive & (at == b)), *blocks[b][2:])

    def score(self, mine: np.ndarray, rows: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        """A whole block, for some of the queries."""
        self.scored += len(mine)
        scores = dot(self.queries[mine], values)
        out = (rows[None, :] == self.rows[mine][:, None]) | (scores < self.floors[mine][:, None])
        better = (~out & (self.none[mine, -1:] | (scores >= self.scores[mine, -1:]))).any(1)
        mine, scores, out = mine[better], scores[better], out[better]
        scores = np.c_[self.scores[mine], scores]
        ids = np.c_[self.ids[mine], np.broadcast_to(ids, (len(mine), len(ids)))]
        none = np.c_[self.none[mine], out]
        best = np.lexsort((ids, ~scores, none), axis=1)[:, : self.k]
        self.scores[mine], self.ids[mine], self.none[mine] = (np.take_along_axis(x, best, 1) for x in (scores, ids, none))

    def found(self) -> pa.RecordBatch:
        i, j = np.nonzero(~self.none)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (i, self.ids[i, j], self.scores[i, j])], ["q", "vec_id", "score"])


def _numbers(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.int64)


def index_blocks(vectors: DataFrame, n: int, dims: int, rows: int) -> DataFrame:
    """(block, high, low, rows, ids, values) of ``n`` vectors: blocks of consecutive ids, named by their first row, with the
    extremes of each dimension, as 64-bit numbers; shorter vectors are padded with zeros.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            values = np.zeros((len(held[0]), dims), np.int64)
            for i, v in enumerate(held[2]):
                values[i, : len(v)] = v
            cells = [values.max(0), values.min(0), *(np.array(x, np.int64) for x in held[:2]), values]
            first = held[0][0]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([first]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["block", "high", "low", "rows", "ids", "values"])

        for batch in batches:
            for row, vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for x, new in zip(held, (row, vec_id, vector.values.to_numpy()), strict=True):
                    x.append(new)
                if len(held[0]) == rows:
                    yield flush()
        if held[0]:
            yield flush()

    ranged = vectors.repartitionByRange(max(1, -(-n // (rows * PART_BLOCKS))), "vec_id").sortWithinPartitions("vec_id", "row")
    return ranged.mapInArrow(run, "block long, high binary, low binary, rows binary, ids binary, values binary")


def first_blocks(blocks: DataFrame, sent: Broadcast) -> DataFrame:
    """(block, asked): for each query the FIRST blocks of the whole table with the highest bounds; asked lists the queries of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value[1]
        names, reach = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))
        for whole in batches:
            for lo in range(0, whole.num_rows, PART_BLOCKS):
                some = whole.slice(lo, PART_BLOCKS)
                high, low = (np.stack([_numbers(c) for c in some.column(n)]) for n in ("high", "low"))
                new = np.broadcast_to(some.column("block").to_numpy(), (len(queries), some.num_rows))
                names, reach = np.c_[names, new], np.c_[reach, bounds(queries, high, low)]
                best = np.lexsort((names, -reach), axis=1)[:, :FIRST]
                names, reach = (np.take_along_axis(x, best, 1) for x in (names, reach))
        q = np.repeat(np.arange(len(queries)), names.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (q, names.ravel(), reach.ravel())], ["q", "block", "reach"])

    order = Window.partitionBy("q").orderBy(F.desc("reach"), "block")
    best = blocks.select("block", "high", "low").mapInArrow(run, "q long, block long, reach double")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= FIRST)
    return best.groupBy("block").agg(F.collect_list("q").alias("asked"))


def _score_first(blocks: DataFrame, sent: Broadcast, dims: int, k: int) -> DataFrame:
    """(q, vec_id, score): k places a query from each task. blocks: (rows, ids, values, asked), each scored by the queries that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, k)
        for batch in batches:
            for *cells, asked in zip(*batch.columns, strict=True):
                rows, ids, values = map(_numbers, cells)
                search.score(np.sort(asked.values.to_numpy()), rows, ids, values.reshape(-1, dims))
        yield search.found()

    return blocks.select("rows", "ids", "values", "asked").mapInArrow(run, "q long, vec_id long, score long")


def _score_rest(blocks: DataFrame, sent: Broadcast, floors: Broadcast, dims: int, k: int, visits: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    """(q, vec_id, score): k places a query from each task, by its blocks but those that the query has asked for before."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        held, done, size = [], [], 0
        for batch in batches:
            for *cells, asked in zip(*batch.columns, strict=True):
                high, low, rows, ids, values = map(_numbers, cells)
                held.append((high, low, rows, ids, values.reshape(-1, dims)))
                done.append(asked.values.to_numpy() if asked.is_valid else np.zeros(0, np.int64))
                size += values.nbytes
                if size >= HELD_BYTES:
                    yield held, done
                    held, done, size = [], [], 0
        if held:
            yield held, done

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, k, floors.value)
        for held, done in read(batches):
            search.take(held, done)
        if visits:
            visits[0].add(search.scored)
            visits[1].add(search.met)
        yield search.found()

    return blocks.select("high", "low", "rows", "ids", "values", "asked").mapInArrow(run, "q long, vec_id long, score long")


def _answers(blocks: DataFrame, asked: list, dims: int, k: int, visits: tuple[Accumulator, Accumulator] | None) -> DataFrame:
    """(query_id, rank, vec_id, score) of a batch of queries, written. asked: rows of bounded bytes."""
    spark = blocks.sparkSession
    queries = np.zeros((len(asked), dims), np.int64)
    for i, r in enumerate(asked):
        queries[i, : len(r["v"])] = r["v"]
    sent = spark.sparkContext.broadcast((np.array([r["row"] for r in asked], np.int64), queries))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    sought = F.broadcast(store(first_blocks(blocks, sent), "first-blocks"))  # FIRST numbers a query of the batch
    first = store(ranked(_score_first(blocks.join(sought, "block"), sent, dims, k)), "first-scores")
    kth = first.filter(F.col("rank") == k).select("q", "score").toArrow()  # one number a query of the batch
    floors = np.full(len(asked), LOWEST)
    floors[kth["q"].to_numpy()] = kth["score"].to_numpy()
    floors = spark.sparkContext.broadcast(floors)
    rest = _score_rest(blocks.join(sought, "block", "left"), sent, floors, dims, k, visits)
    names = spark.createDataFrame(pa.table({"q": np.arange(len(asked)), "query_id": np.array([r["vec_id"] for r in asked], np.int64)}))
    best = ranked(first.drop("rank").unionByName(rest)).join(F.broadcast(names), "q")
    out = store(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "answers", keep=True)
    sent.destroy()
    floors.destroy()
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block_rows: int = BLOCK_ROWS, query_bytes: int = QUERY_BYTES, visits: tuple[Accumulator, Accumulator] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best integer inner products of every row that ``queries`` picks, against all others.

    ``queries`` is a condition on ``vec_id``. Ties go to the smaller id; a query with fewer candidates has fewer rows.
    Vectors that are null or hold null or non-finite components take no part, neither do null ids; shorter vectors are
    padded with zeros. Rows that repeat an id are rows like any others: each may be a query and a candidate, and a query
    leaves out its own row only. Components and scores beyond 64 bits count as the largest or smallest long. An empty
    table gives an empty result. Other columns are ignored. ``visits`` are two accumulators: pairs of a query and a block that
    are scored after the first blocks, and all pairs.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("v"))
    with scratch(spark):
        rows, seen = store_observed(rows, "vectors", F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims"), F.count(F.when(queries, 1)).alias("asked"))
        n, asked = seen.get("n") or 0, seen.get("asked") or 0
        if not asked:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        dims = max(1, seen["dims"])
        blocks = store(index_blocks(rows, n, dims, block_rows), "vector-blocks")
        batches = max(1, -(-asked * max(dims * 8, ONE_QUERY) // query_bytes))
        batch = F.pmod(F.xxhash64("row"), F.lit(batches))
        found = [_answers(blocks, some, dims, k, visits) for b in range(batches) if (some := rows.filter(queries & (batch == b)).collect())]
    return reduce(DataFrame.unionByName, found)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the ten best of every vector whose id is divisible by 100, against all of ``embeddings``.

    Null vectors and those with null or non-finite components take no part; ties go to the smaller id; an empty table
    gives no rows.
    """
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
