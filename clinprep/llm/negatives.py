"""Hard-negative mining with rotated one-bit codes.

A vector is rotated (random signs and a Hadamard transform, twice) and the signs of what comes out are its code: a
unit vector whose components differ in sign only. Stored with it is the alignment, the inner product of vector and code. What
the code leaves over is rotated anew and gets a code of its own, LEVELS times; the norm of the last remainder is stored too.
An inner product is then the sum over levels of alignment times (query . code), which popcounts over the bit planes of the
quantised query tell up to a known rounding error, plus (query . remainder), which the Cauchy-Schwarz inequality bounds by the norms
of the remainder and of what is left of the query beside the last code. So every score has an interval that surely holds it.

Blocks of codes meet a batch of anchors. Lower ends of intervals, and scores so far, give each anchor a bound; only rows
whose interval reaches it are scored, in whole numbers. A first job finds the positives, which set
each (anchor, positive) pair the range of scores its negatives must have; a second one finds those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinprep.llm.text import small_batches, table
from clinprep.llm.topk import quantised, usable
from clinprep.sources.shared import store

LEVELS, PLANES, SEED = 4, 6, 11
#: Rows of a block, blocks that a task takes at a time and in all, and anchors that meet them at a time.
BLOCK_ROWS, TURN, PART_BLOCKS, ANCHORS = 256, 4, 16, 256
#: Bytes of a batch of anchors, which each task holds whole.
ANCHOR_BYTES = 16 << 20
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthogonal Hadamard transform of each row, whose length is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        half *= 2
    return x / np.sqrt(d)


@dataclass
class Codes:
    """Rows as codes: bits (rows, levels, words), alignments (rows, levels), and the norm of the last remainder."""

    bits: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


class Rotations:
    """LEVELS rotations of vectors of ``dims`` components, padded with zeros to a power of two of 64 or more."""

    def __init__(self, dims: int):
        self.dims = max(64, 1 << (max(1, dims) - 1).bit_length())
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (LEVELS, 2, self.dims))

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(float), ((0, 0), (0, self.dims - x.shape[1])))

    def turned(self, x: np.ndarray, level: int) -> np.ndarray:
        for s in self.signs[level]:
            x = hadamard(x * s)
        return x

    def encode(self, values: np.ndarray) -> Codes:
        x = self.padded(values)
        norm, bits, align = np.linalg.norm(x, axis=1), [], []
        for level in range(LEVELS):
            x = self.turned(x, level)
            bits.append(np.packbits(x > 0, axis=1, bitorder="little").view(np.uint64))
            code = np.where(x > 0, 1.0, -1.0) / np.sqrt(self.dims)
            align.append((x * code).sum(1))
            x = x - align[-1][:, None] * code
        return Codes(np.stack(bits, 1), np.stack(align, 1), np.linalg.norm(x, axis=1), norm)


class Questions:
    """Anchors as quantised rotations: PLANES bit planes a level, with the rounding errors they leave."""

    def __init__(self, turns: Rotations, values: np.ndarray):
        self.dims = turns.dims
        x = turns.padded(values)
        self.norm = np.linalg.norm(x, axis=1)
        self.low, self.step, self.total, self.error, self.planes = [], [], [], [], []
        for level in range(LEVELS):
            x = turns.turned(x, level)
            low = x.min(1)
            step = np.maximum((x.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
            u = np.clip(np.rint((x - low[:, None]) / step[:, None]), 0, (1 << PLANES) - 1).astype(np.uint8)
            self.low.append(low)
            self.step.append(step)
            self.total.append(u.sum(1, dtype=np.int64))
            self.error.append(np.linalg.norm(x - low[:, None] - step[:, None] * u, axis=1))
            self.planes.append([np.packbits(u >> p & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)])

    def intervals(self, codes: Codes, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) that the score of each of some anchors with each row can be."""
        middle = np.zeros((len(self.norm[some]), len(codes.rest)))
        width = np.zeros_like(middle)
        for level in range(LEVELS):
            bits = codes.bits[:, level]
            inside = np.zeros(middle.shape, np.int64)
            for p, plane in enumerate(self.planes[level]):
                for w in range(bits.shape[1]):
                    inside += np.bitwise_count(plane[some, w, None] & bits[None, :, w]).astype(np.int64) << p
            ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
            low, step = self.low[level][some, None], self.step[level][some, None]
            along = (low * (2 * ones - self.dims)[None, :] + step * (2 * inside - self.total[level][some, None])) / np.sqrt(self.dims)
            middle += along * codes.align[None, :, level]
            width += np.abs(codes.align[None, :, level]) * self.error[level][some, None]
        # beside the last code: |q|^2 less what lies along it at least
        beside = np.maximum(np.abs(along) - self.error[-1][some, None], 0.0)
        across = np.sqrt(np.maximum(self.norm[some, None] ** 2 - beside**2, 0.0))
        width += across * codes.rest[None, :] + 1e-9 * self.norm[some, None] * codes.norm[None, :]
        return middle - width, middle + width


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner product of each row of a with the same row of b; beyond 64 bits the largest or smallest long."""
    size = (np.abs(a.astype(float)) * np.abs(b.astype(float))).sum(1)
    out = np.einsum("ij,ij->i", a, b)
    for i in np.flatnonzero(size >= 2.0**62):
        out[i] = min(max(sum(x * y for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)), LOWEST), HIGHEST)
    return out


class Best:
    """The k best rows of each of n lists, by score, then smaller id, then smaller row."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.rows = (np.zeros((n, k), np.int64) for _ in range(3))
        self.none = np.ones((n, k), bool)

    def last(self) -> np.ndarray:
        """The score of the last place of each list, or minus infinity while it is free."""
        return np.where(self.none[:, -1], -np.inf, self.scores[:, -1].astype(float))

    def add(self, lists: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Candidates in any order, each for one list."""
        held = np.unique(lists)
        old = np.repeat(held, self.k)
        stays = ~self.none[held].ravel()
        lists, scores, ids, rows = (np.r_[x, y.ravel()[stays]] for x, y in ((lists, old), (scores, self.scores[held]), (ids, self.ids[held]), (rows, self.rows[held])))
        order = np.lexsort((rows, ids, ~scores, lists))
        lists = lists[order]
        place = np.arange(len(lists)) - np.searchsorted(lists, lists)
        order, lists, place = (x[place < self.k] for x in (order, lists, place))
        self.none[held] = True
        self.none[lists, place] = False
        self.scores[lists, place], self.ids[lists, place], self.rows[lists, place] = scores[order], ids[order], rows[order]


class Mining:
    """A task's search: for each anchor (positives), or each pair of anchor and positive (negatives), the best k."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, values: np.ndarray, k: int, limits: tuple[np.ndarray, np.ndarray] | None = None):
        """limits: for negatives, the lowest and the highest score of each anchor's pairs; a pair that isn't there has them crossed."""
        self.rows, self.labels, self.values, self.k = rows, labels, values, k
        self.turns = Rotations(values.shape[1])
        self.asked = Questions(self.turns, values)
        self.limits = limits
        self.lists = 1 if limits is None else limits[0].shape[1]
        self.best = Best(len(rows) * self.lists, k)
        self.scored = self.met = 0  # pairs

    def take(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, codes: Codes) -> None:
        for at in range(0, len(self.rows), ANCHORS):
            some = slice(at, min(at + ANCHORS, len(self.rows)))
            same = self.labels[some, None] == labels[None, :]
            fits = same & (self.rows[some, None] != rows[None, :]) if self.limits is None else ~same
            low, high = self.asked.intervals(codes, some)
            self.met += low.size
            i, j = np.nonzero(fits & self._reach(some, np.where(fits, low, -np.inf), high))
            self.scored += len(i)
            for cut in range(0, len(i), 1 << 17):
                a, b = i[cut : cut + (1 << 17)], j[cut : cut + (1 << 17)]
                self._offer(a + at, ids[b], rows[b], pair_scores(self.values[a + at], values[b]))

    def _reach(self, some: slice, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows that may be among the best of one of the anchor's lists."""
        last = self.best.last().reshape(-1, self.lists)[some]
        kth = lambda x: np.partition(x, x.shape[1] - self.k, axis=1)[:, -self.k, None] if x.shape[1] >= self.k else np.full((len(x), 1), -np.inf)
        if self.limits is None:
            return high >= np.maximum(last, kth(low))
        out = np.zeros(low.shape, bool)
        for p in range(self.lists):
            least, most = (x[some, p, None] for x in self.limits)
            sure = np.where((low >= least) & (high <= most), low, -np.inf)  # surely within the range
            out |= (high >= np.maximum(np.maximum(last[:, p, None], least), kth(sure))) & (low <= most)
        return out

    def _offer(self, anchors: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        if self.limits is None:
            return self.best.add(anchors, scores, ids, rows)
        for p in range(self.lists):
            ok = (scores >= self.limits[0][anchors, p]) & (scores <= self.limits[1][anchors, p])
            self.best.add(anchors[ok] * self.lists + p, scores[ok], ids[ok], rows[ok])

    def found(self) -> pa.RecordBatch:
        """(anchor, list, row, id, score): anchors by their number in the batch."""
        n, k = np.nonzero(~self.best.none)
        cells = [n // self.lists, n % self.lists, self.best.rows[n, k], self.best.ids[n, k], self.best.scores[n, k]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], [c.split()[0] for c in FOUND.split(", ")])


FOUND = "anchor long, list long, row long, id long, score long"
BLOCK = ["rows", "ids", "labels", "values", "bits", "align", "rest", "norm"]


def index(vectors: DataFrame, dims: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of vectors (row, id, label, v) with their codes, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, held = Rotations(dims), []

        def block() -> pa.RecordBatch:
            values = np.zeros((len(held), dims), np.int64)
            for i, r in enumerate(held):
                values[i, : len(r[3])] = r[3]
            codes = turns.encode(values)
            cells = [*(np.array([r[c] for r in held], np.int64) for c in range(3)), values, codes.bits, codes.align, codes.rest, codes.norm]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells], BLOCK)

        for batch in batches:
            for row, vec_id, label, v in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                held.append((row, vec_id, label, v.values.to_numpy()))
                if len(held) == rows:
                    yield block()
        if held:
            yield block()

    parts = max(1, -(-vectors.count() // (rows * PART_BLOCKS)))
    return vectors.repartition(int(parts), "row").mapInArrow(run, ", ".join(f"{c} binary" for c in BLOCK))


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(rows, ids, labels, values, codes) of TURN blocks at a time."""
    held: list[list[np.ndarray]] = []

    def turn() -> tuple:
        rows, ids, labels, values, bits, align, rest, norm = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        return rows, ids, labels, values, Codes(bits, align, rest, norm)

    for batch in batches:
        for cells in zip(*batch.columns, strict=True):
            raw = [np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, [np.int64] * 4 + [np.uint64] + [np.float64] * 3, strict=True)]
            n = len(raw[0])
            held.append([*raw[:3], raw[3].reshape(n, dims), raw[4].reshape(n, LEVELS, -1), raw[5].reshape(n, LEVELS), *raw[6:]])
            if len(held) == TURN:
                yield turn()
    if held:
        yield turn()


def _search(blocks: DataFrame, dims: int, sent) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mining = Mining(*sent.value)
        for some in _read(batches, dims):
            mining.take(*some)
        yield mining.found()

    return blocks.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("anchor", "list").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def share_up(score: np.ndarray, percent: int) -> np.ndarray:
    """The smallest whole number whose hundredfold is at least percent times the score, without leaving 64 bits."""
    return -share_down(-score, percent) if score.size else score


def share_down(score: np.ndarray, percent: int) -> np.ndarray:
    """The largest whole number whose hundredfold is at most percent times the score, without leaving 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    ``anchors`` is a condition on ``vec_id``, ``label`` an expression for the class (default: the column ``label``). Vectors become
    floor(scale * x). An anchor's positives are the ``positives`` rows of its own label that score highest, itself left out;
    the negatives of a pair are the first ``negatives`` rows of other labels whose score lies from ``low`` to ``high`` percent of the
    positive's. Ties go to the smaller id. Rows without label, id or vector, or with a component that is null or not finite,
    take no part; shorter vectors are padded with zeros. Rows that repeat an id are rows like any others. Scores
    beyond 64 bits count as the largest or smallest long. An empty table gives an empty result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    label = F.col("label") if label is None else label
    ok = usable(F.col(vector_col)) & F.col(id_col).isNotNull() & label.isNotNull()
    rows = store(vectors.filter(ok).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v")), "labelled-vectors")
    dims = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    blocks = store(index(rows, dims), "code-blocks")
    asked = rows.filter(anchors)
    batches = max(1, -(-asked.count() * dims * 8 // anchor_bytes))
    asked = asked.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)))
    out = []
    for b in range(batches):
        mine = asked.filter(F.col("batch") == b).select("row", "vec_id", "label", "v").collect()  # anchor_bytes at most
        if mine:
            out.append(_mined(spark, blocks, mine, dims, positives, negatives, low, high))
    if not out:
        return spark.createDataFrame([], MINED)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def _mined(spark: SparkSession, blocks: DataFrame, anchors: list, dims: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """A batch of anchors: positives first, then the negatives within the ranges they set."""
    values = np.zeros((len(anchors), dims), np.int64)
    for i, r in enumerate(anchors):
        values[i, : len(r["v"])] = r["v"]
    row, label, ids = (np.array([r[c] for r in anchors], np.int64) for c in ("row", "label", "vec_id"))
    sent = spark.sparkContext.broadcast((row, label, values, positives))
    best = _ranked(_search(blocks, dims, sent), positives).select("anchor", "rank", "id", "score").collect()  # `positives` an anchor
    sent.destroy()
    # a pair that isn't there: its lowest score is above its highest
    scores, ranges = np.zeros((len(anchors), positives), np.int64), np.zeros((2, len(anchors), positives), np.int64)
    ranges[0], ranges[1] = HIGHEST, LOWEST
    there = np.array([(r["anchor"], r["rank"] - 1, r["id"], r["score"]) for r in best], np.int64).reshape(-1, 4)
    a, p = there[:, 0], there[:, 1]
    scores[a, p] = there[:, 3]
    ranges[0, a, p], ranges[1, a, p] = share_up(there[:, 3], low), share_down(there[:, 3], high)
    sent = spark.sparkContext.broadcast((row, label, values, negatives, (ranges[0], ranges[1])))
    found = store(_ranked(_search(blocks, dims, sent), negatives), "negatives")
    sent.destroy()
    pairs = spark.createDataFrame(pa.table({"anchor": a, "list": p, "anchor_id": ids[a], "positive_id": there[:, 2], "positive_score": there[:, 3]})) if len(there) else spark.createDataFrame([], "anchor long, list long, anchor_id long, positive_id long, positive_score long")
    named = found.join(pairs, ["anchor", "list"])
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``embeddings`` whose id is divisible by 50.

    Where the id is divisible by 7, the label is the next one of ten. Null labels and vectors, and those with null or non-finite
    components, take no part; ties go to the smaller id; an empty table gives no rows.
    """
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, q.label = d.label AS same, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), p AS (
  SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
         s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
