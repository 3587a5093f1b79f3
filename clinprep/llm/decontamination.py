r"""Benchmark decontamination by winnowing.

Words are hashed, GRAM consecutive words make a k-gram hash, and of every WINDOW consecutive k-grams of a text the smallest hash is kept
(the last one of equals): a span of GRAM + WINDOW - 1 words that two texts share has a kept k-gram in both of them.
Kept k-grams of benchmark items carry the words around them, so far as a span of that length can reach;
equal surroundings are one context, however many items have it. A task over the documents keeps their k-grams too and, of those,
the ones that a bitmap of the benchmark's hashes lets through go on with the words around them (the bitmap
has a fixed size, whatever the size of the benchmark). They join the contexts by hash; a hit is extended word by word to
both sides, and what has the length of a window is a shared span. Hashes only propose; words decide.

An item of fewer words than a window is one window by itself: its only k-gram is the whole of it, and documents keep all
their k-grams of such a length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinprep.llm.text import BROADCAST_BYTES, small_batches, table
from clinprep.sources.shared import store

#: Words of a window of the contract, and of a k-gram; WINDOW k-grams lie in a window of SPAN words.
SPAN, GRAM = 10, 8
#: Bits of the map of the benchmark's hashes, as a power of two: 4 MB.
MAP_BITS = 25
#: Bytes of documents that a task looks at at a time, and bytes whose words are hashed at a time.
BYTES, PIECE = 2_000_000, 1 << 18
#: Bytes of a row of contexts besides its words.
ROW_BYTES = 64
#: By byte: itself where it belongs to a word, with A-Z lower-cased, else 0.
LETTER = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0 for b in range(256)], np.uint8)
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2^64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)], dtype=np.uint64)


class Words:
    """The words of some texts, one text after the other: their bytes' places, text, and hashes."""

    def __init__(self, texts: list[bytes]):
        raw = b"\0".join([*texts, b""])  # nothing runs on into the next text
        self.letters = LETTER[np.frombuffer(raw, np.uint8)]
        inside = np.r_[False, self.letters != 0, False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.stop = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, "right")
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.count) - self.count
        self.hash = np.zeros(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):  # whole words of about PIECE bytes
            hi = max(lo + 1, int(np.searchsorted(self.stop, self.start[lo] + PIECE, "right")))
            self.hash[lo:hi] = self._hashed(lo, hi)
            lo = hi

    def _hashed(self, lo: int, hi: int) -> np.ndarray:
        """A polynomial of each word's letters, shifted to the word's own place: the base is odd and has an inverse."""
        at = self.start[lo]
        start, stop, letters = self.start[lo:hi] - at, self.stop[lo:hi] - at, self.letters[at : self.stop[hi - 1]]
        up, down = (powers(base, 1 << max(PIECE - 1, len(letters)).bit_length())[: len(letters)] for base in (BASE, pow(BASE, -1, 1 << 64)))
        total = np.r_[np.uint64(0), np.cumsum(letters * up, dtype=np.uint64)]
        h = (total[stop] - total[start]) * down[start]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
        return h ^ (h >> np.uint64(32))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, hash) of each k-gram that lies in one text; k takes part in the hash."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, k, np.uint64)
        for i in range(k):
            h = (h ^ self.hash[i : i + n]) * np.uint64(BASE)
            h ^= h >> np.uint64(31)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return at, h[at]

    def kept(self, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of k-grams of a text the last with the smallest hash. Texts with fewer k-grams keep none."""
        at, h = self.grams(k)
        n = len(at) - window + 1
        if n <= 0:
            return at[:0], h[:0]
        best, where = h[window - 1 :].copy(), np.arange(window - 1, len(h))
        for i in range(window - 2, -1, -1):
            less = h[i : i + n] < best
            best[less] = h[i : i + n][less]
            where[less] = np.flatnonzero(less) + i
        whole = at[window - 1 :] - at[:n] == window - 1
        whole &= self.text[at[:n]] == self.text[at[window - 1 :]]
        some = np.unique(where[whole])
        return at[some], h[some]

    def around(self, at: np.ndarray, k: int, reach: int) -> tuple[list[bytes], np.ndarray]:
        """The words from ``reach`` before a k-gram to ``reach`` after it, joined by spaces, within the text; how many come before."""
        if not len(at):
            return [], at
        text = self.text[at]
        lo = np.maximum(at - reach, self.first[text])
        hi = np.minimum(at + k + reach, self.first[text] + self.count[text])
        raw = self.letters.tobytes()
        start, stop = self.start.tolist(), self.stop.tolist()
        spaced = [b" ".join([raw[start[w] : stop[w]] for w in range(a, b)]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        return spaced, at - lo


def _kept(words: Words, lengths: list[int], span: int, gram: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(words of a window, words of a k-gram, places, hashes): kept k-grams of windows, and all k-grams of each shorter length."""
    return [(span, gram, *words.kept(gram, span - gram + 1)), *((k, k, *words.grams(k)) for k in lengths)]


CONTEXTS = "item_id string, fp long, need int, gram int, before int, words binary"


def _contexts(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _some(batches):
            words = Words(texts)
            for need, k, at, h in _kept(words, sorted(set(words.count[words.count < span].tolist()) - {0}), span, gram):
                if need < span:  # an item of so many words is its own k-gram
                    mine = words.count[words.text[at]] == k
                    at, h = at[mine], h[mine]
                spaced, before = words.around(at, k, need - k)
                kinds = (np.full(len(at), x, np.int32) for x in (need, k))
                cells = [batch.column(0).take(pa.array(words.text[at])), pa.array(h.view(np.int64)), *map(pa.array, kinds), pa.array(before.astype(np.int32)), pa.array(spaced, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in CONTEXTS.split(", ")])

    return run


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of about BYTES at a time; the last column has the texts."""
    for batch in batches:
        texts, lo, size = [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= BYTES or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0


MARKS = "row_id long, doc_id long, n_words long, fp long, need int, at long, before int, words binary"


def _marks(sent, lengths: list[int], span: int, gram: int):
    """A row for each document, with its number of words, and one for each of its k-grams that the map lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, names = np.frombuffer(sent.value, np.uint8), [c.split()[0] for c in MARKS.split(", ")]
        for batch, texts in _some(batches):
            words = Words(texts)
            n = batch.num_rows
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.count.astype(np.int64)), *none], names)
            for need, k, at, h in _kept(words, lengths, span, gram):
                place = (h >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                through = (bits[place >> 3] >> (place & 7)) & 1 == 1
                at, h = at[through], h[through]
                spaced, before = words.around(at, k, need - k)
                text = words.text[at]
                cells = [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), pa.nulls(len(at), pa.int64()), pa.array(h.view(np.int64)), pa.array(np.full(len(at), need, np.int32)), pa.array((at - words.first[text]).astype(np.int64)), pa.array(before.astype(np.int32)), pa.array(spaced, pa.binary())]
                yield pa.RecordBatch.from_arrays(cells, names)

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, context, start, length) of the hits whose words agree over a whole window."""
    for batch in batches:
        out = []
        for row, context, at, need, gram, x_before, y_before, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = x.split(b" "), y.split(b" ")
            if x[x_before : x_before + gram] != y[y_before : y_before + gram]:
                continue
            lo = hi = 0
            while lo < min(x_before, y_before) and x[x_before - lo - 1] == y[y_before - lo - 1]:
                lo += 1
            while x_before + gram + hi < len(x) and y_before + gram + hi < len(y) and x[x_before + gram + hi] == y[y_before + gram + hi]:
                hi += 1
            if lo + gram + hi >= need:
                out.append((row, context, at - lo, lo + gram + hi))
        cells = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], ["row_id", "context", "start", "length"])


def _map(contexts: DataFrame):
    """The bitmap of the contexts' hashes: tasks make rows (byte, bits), at most 2^MAP_BITS / 8 of them in all."""
    place = F.shiftrightunsigned("fp", 64 - MAP_BITS)
    rows = contexts.select(place.alias("p")).distinct().groupBy(F.floor(F.col("p") / 8).cast("int").alias("byte")).agg(F.expr("sum(shiftleft(1, cast(p % 8 as int)))").alias("bits"))
    found = rows.toArrow()
    out = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return contexts.sparkSession.sparkContext.broadcast(out.tobytes())


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    r"""Documents (row_id, doc_id, n_words, n_hit, n_items, item_ids) and the shared spans (row_id, item_id, start, length).

    Texts are lower-cased (A-Z) and cut into words of letters, digits and everything beyond ASCII. ``span`` consecutive words of an item
    are a window, an item of fewer words is one window; a document word is hit if it lies in an occurrence of a window. item_ids are
    the ids of the items with such windows, sorted as strings. Spans are as long as the words around one k-gram
    show: longer ones are several that overlap.
    Null and empty texts have no words. Repeated documents are rows of their own. Items that repeat an id are one in
    item_ids; those with a null id hit words but are not listed. Empty tables give no hits, or no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    tests = items.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string"))
    found = store(tests.mapInArrow(_contexts(span, gram), CONTEXTS), "item-contexts")
    distinct = found.select("fp", "need", "gram", F.col("before").alias("y_before"), F.col("words").alias("y")).distinct()
    contexts = store(distinct.withColumn("context", F.monotonically_increasing_id()), "contexts")
    lengths = sorted(r["need"] for r in contexts.filter(F.col("need") < span).select("need").distinct().collect())  # below span
    sent = _map(contexts)
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = store(base.mapInArrow(_marks(sent, lengths, span, gram), MARKS), "marks")
    sent.destroy()
    size = contexts.agg(F.sum(F.octet_length("y") + ROW_BYTES)).first()[0] or 0
    hits = marks.filter("fp is not null").join(F.broadcast(contexts) if size <= BROADCAST_BYTES else contexts, ["fp", "need"])
    hits = hits.select("row_id", "context", "at", "need", "gram", "before", "y_before", "words", "y")
    spans = store(hits.mapInArrow(_extend, "row_id long, context long, start long, length long"), "spans")
    return _answers(marks, spans, contexts, found)


def _answers(marks: DataFrame, spans: DataFrame, contexts: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    # hit words: what each span adds to those that start before it
    before = Window.partitionBy("row_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("start") + F.col("length")
    added = spans.select("row_id", "start", "length").distinct().withColumn("far", F.coalesce(F.max(stop).over(before), F.col("start")))
    words = added.groupBy("row_id").agg(F.sum(F.greatest(F.lit(0), stop - F.greatest("start", "far"))).alias("n_hit"))
    # the items of the contexts that were met
    met = spans.select("row_id", "context").distinct()
    named = contexts.select("context", "fp", "need", F.col("y_before").alias("before"), F.col("y").alias("words"))
    holders = named.join(met.select("context").distinct(), "context", "left_semi").join(found, ["fp", "need", "before", "words"]).select("context", "item_id").distinct()
    holders = store(holders, "holders")
    pairs = met.join(holders, "context").select("row_id", "item_id").distinct()
    listed = pairs.groupBy("row_id").agg(F.count("item_id").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    rows = marks.filter("fp is null").select("row_id", "doc_id", "n_words").join(words, "row_id", "left").join(listed, "row_id", "left")
    none = F.array().cast("array<string>")
    out = rows.select("row_id", "doc_id", "n_words", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_hit", "n_items")], F.coalesce("item_ids", none).alias("item_ids"))
    return out, spans.join(holders, "context").select("row_id", "item_id", "start", "length").distinct()


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``documents`` against ``benchmark``.

    Null and empty texts have no words; repeated rows come back each time; an empty benchmark hits nothing; no documents give no rows.
    """
    out, _ = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM iw
), lengths AS (
  SELECT DISTINCT n FROM windows
), dp AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN lengths ON len(w) >= n
), dw AS (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM dp
), hits AS (
  SELECT DISTINCT dw.r, dw.p, dw.n, windows.item_id FROM dw JOIN windows USING (n, words)
), places AS (
  SELECT DISTINCT r, unnest(range(p, p + n)) AS at FROM hits
), hit AS (
  SELECT r, count(*) AS n_hit FROM places GROUP BY r
), item AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
