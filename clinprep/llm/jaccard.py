"""Near copies: MinHash bands propose candidates, pigeonring filtering of SimHash fingerprints and parity bitmaps prune them, and the Jaccard
similarity of the shingle sets decides.

A similarity of 0.8 turns about 0.15 of the bits of a fingerprint of distinct shingles, 19 of 128 with a spread of 4. Buckets of
segments that reach so far hold a fixed share of all documents, so the work would grow with the square of the corpus. Candidates
therefore meet where a band of BAND minimal hashes is equal, which two sets do by their similarity to that power: of pairs at 0.8
all but 0.04 percent meet in one of BANDS bands, and sets that share little never do. A pair goes on if its fingerprints keep
some chain of the ring within RING bits. The XOR of two parity bitmaps never has more bits than their sets have unshared
shingles, so bitmaps rule out further pairs. What passes is decided by the sets of 64-bit hashes.

A large group of copies would meet in n^2 pairs, so links are found in two rounds. In the first, documents meet the smallest
id of each of their buckets only, which mostly makes one component of such a group; in the second, rows that are in different
components by then are compared: the largest component of a bucket takes no part in comparisons within itself, and buckets of one
component are left out. A bucket that still has very many rows is dealt out over a grid of tasks. Every fingerprint carries a
short parity bitmap into its buckets: a pair leaves a task only if that bitmap does not rule it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinprep.llm import simhash
from clinprep.llm.graph import components
from clinprep.llm.text import small_batches
from clinprep.sources.shared import store

#: The similarity is SHARE / OF, in whole numbers so that a pair right at it is told exactly.
SHARE, OF = 4, 5
#: 34 bits of 128: of pairs at a similarity of 0.8 nearly all are within it.
RING = simhash.Ring(34, widths=(13, 13, 13, 13, 12) * 2, budgets=(3, 2) * 5)
#: Minimal hashes of a band, and bands.
BAND, BANDS = 5, 20
#: Hashes of a set that meet all multipliers at a time.
HASHES = 8_192
NAMES = [f"f{i}" for i in range(RING.lanes)]
#: Words of 64 bits of the bitmap that goes with a fingerprint into its buckets, and their columns.
SKETCH = 4
SKETCHED = [f"g{i}" for i in range(SKETCH)]
#: Texts that a task holds at a time.
TEXTS = 256


def shingles(text: bytes, words: int) -> tuple[np.ndarray, list[int]]:
    """The sorted set of hashes of the word shingles, and the fingerprint of that set. No words: no shingles, zeros."""
    lanes = simhash.shingle_hashes(text, words, RING.lanes)
    h, at = np.unique(lanes[0], return_index=True)
    return h, [simhash.majority(lane[at]) for lane in lanes]


def parity(h: np.ndarray, bits: int = 0) -> bytes:
    """For each residue whether an odd number of hashes has it; by default as many bits as hashes, rounded up to a power of two."""
    bits = bits or max(64, 1 << (len(h) - 1).bit_length())
    odd = np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch(h: np.ndarray) -> list[int]:
    """A parity bitmap of fixed size, as signed longs."""
    return np.frombuffer(parity(h, 64 * SKETCH), np.int64).tolist()


def unshared(x: bytes, y: bytes) -> int:
    """At least so many shingles are in one of two sets only, by their bitmaps; the wider one is folded."""
    n = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint64).reshape(-1, n // 8), axis=0) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(5)
    return tuple(g.integers(0, 1 << 63, (2, BAND * BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def bands(h: np.ndarray) -> list[int]:
    """A 32-bit number for each band of the set's minimal hashes; an empty set has numbers of its own."""
    times, plus = _multipliers()
    least = np.full(BAND * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), HASHES):
        least = np.minimum(least, (h[at : at + HASHES, None] * times + plus).min(0))
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.int64).tolist()


def _mapped(docs: DataFrame, row, words: int, columns: str) -> DataFrame:
    """``row(hashes, fingerprint)`` of each document, as columns after doc_id."""
    names, kinds = zip(*(c.split() for c in columns.split(", ")), strict=True)
    arrow = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                rows = [row(*shingles(t.encode(), words)) for t in batch.column(1).to_pylist()]
                cols = [pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *names])

    return docs.mapInArrow(run, "doc_id long, " + columns)


def _close(size: Column, other: Column) -> Column:
    return (size * OF >= other * SHARE) & (other * OF >= size * SHARE)


def _bucketed(prints: DataFrame, *columns: str) -> DataFrame:
    """A row for each document and band, with ``bucket``: the band and its number."""
    return prints.select(*columns, F.posexplode("bands").alias("band", "number")).select(*columns, (F.col("band").cast("long") * (1 << 32) + F.col("number")).alias("bucket"))


def _heads(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of the smallest id of each bucket and the others in it that are near it."""
    met = _bucketed(prints, "doc_id", "size", *NAMES)
    head = met.groupBy("bucket").agg(F.min(F.struct("doc_id", "size", *NAMES)).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket", "head")
    both = met.join(store(head, "heads"), "bucket")
    bits = reduce(Column.__add__, [F.bit_count(F.col(n).bitwiseXOR(F.col(f"head.{n}"))) for n in NAMES])
    near = both.filter((bits <= RING.bits) & _close(F.col("size"), F.col("head.size")) & (F.col("doc_id") != F.col("head.doc_id")))
    return near.select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _dealt(rows: DataFrame, carried: list[str]) -> DataFrame:
    """(key, kind, rep, carried...) of buckets that hold several components, sorted within partitions by key, kind and size.

    Rows of a bucket's largest component are guests: the others, at home there, meet one another and them.
    """
    slim = _bucketed(rows, "rep", "component")
    counts = slim.groupBy("bucket", "component").count()
    mixed = counts.groupBy("bucket").agg(F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("most"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    # blocks only where there are too many rows for one task
    blocks = lambda c: F.when(c > simhash.HOT_HOMES, F.least(F.ceil(c / simhash.HOT_HOMES), F.lit(simhash.BLOCKS))).otherwise(1).cast("int")
    sizes = store(mixed.select("bucket", F.col("most.component").alias("big"), blocks(F.col("n") - F.col("most.count")).alias("homes"), blocks(F.col("most.count")).alias("probes")), "mixed-buckets")
    placed = slim.join(sizes, "bucket").withColumn("probe", F.col("component") == F.col("big"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("homes"))).cast("int")
    cells = simhash._grid(F.col("homes"), F.col("probes"), own, F.col("probe"))
    plain = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.when(F.col("probe"), simhash.GUEST).otherwise(simhash.HOME).cast("int").alias("kind")))
    dealt = placed.select("rep", "bucket", F.explode(F.when((F.col("homes") == 1) & (F.col("probes") == 1), plain).otherwise(cells)).alias("c"))
    keyed = dealt.select("rep", (F.col("bucket") * (1 << simhash.GRID) + F.col("c.cell")).alias("key"), "c.kind")
    whole = keyed.join(rows.select("rep", *carried), "rep").select("key", "kind", "rep", *carried)
    return whole.repartition("key").sortWithinPartitions("key", "kind", "size")


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a bucket within the ring and in different components that their sketches don't rule out."""
    for key, kind, doc, *words, size, part in simhash.whole_keys(batches):
        words = [w.view(np.uint64) for w in words]
        words, sketched = words[: RING.lanes], words[RING.lanes :]
        size = size.astype(np.int64)
        for _, i, j in simhash.meetings(key, kind, size, SHARE, OF):
            apart = part[i] != part[j]
            i, j = i[apart], j[apart]
            least = sum(np.bitwise_count(g[i] ^ g[j]).astype(np.int64) for g in sketched)
            ok = least * (OF + SHARE) <= (OF - SHARE) * (size[i] + size[j])
            i, j = i[ok], j[ok]
            ok = RING.near([w[i] ^ w[j] for w in words])
            i, j = doc[i[ok]], doc[j[ok]]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets may be similar enough: at most (OF - SHARE) / (OF + SHARE) of both sizes is unshared."""
    for batch in batches:
        x, y = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        least = np.array([unshared(*xy) for xy in zip(x, y, strict=True)], np.int64)
        ok = pa.array(least * (OF + SHARE) <= (OF - SHARE) * np.asarray(batch.column(2)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])


def _similar(pairs: DataFrame, prints: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are as similar as asked; two empty sets are equal."""
    left, right = (prints.select(F.col("doc_id").alias(n), F.col("size").alias(f"n_{n}"), F.col("parity").alias(f"parity_{n}")) for n in ("a", "b"))
    known = pairs.join(left, "a").join(right, "b").select("a", "b", F.expr("n_a + n_b").alias("sizes"), "parity_a", "parity_b")
    pairs = store(known.mapInArrow(_plausible, "a long, b long").distinct(), "plausible")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = store(_mapped(docs.join(nodes, "doc_id", "left_semi"), lambda h, _: (h.view(np.int64),), words, "hashes array<bigint>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("common"))
    return store(common.filter(F.col("common") * (OF + SHARE) >= F.col("sizes") * SHARE).select("a", "b").distinct(), "similar")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, component_id) of the documents that have a near copy; the smallest id reachable names a component.

    Null texts count as empty, texts without words are equal, rows without an id take no part. Rows that repeat an id are
    one document, near what any of its texts is near. Equal texts are near copies. An empty table gives no rows. Other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    columns = ", ".join(["size int", "parity binary", *(f"{n} long" for n in [*NAMES, *SKETCHED]), "bands array<bigint>"])
    prints = store(_mapped(base, lambda h, f: (len(h), parity(h), *f, *sketch(h), bands(h)), words, columns), "near-prints")
    first = _similar(_heads(prints), prints, base, words)
    part = components(first).select(F.col("node").alias("doc_id"), "component")
    rows = prints.join(part, "doc_id", "left").select(F.col("doc_id").alias("rep"), *NAMES, *SKETCHED, "size", F.coalesce("component", "doc_id").alias("component"), "bands")
    found = _dealt(store(rows, "parted"), [*NAMES, *SKETCHED, "size", "component"]).mapInArrow(_candidates, "a long, b long")
    second = _similar(store(found.distinct(), "candidates"), prints, base, words)
    return components(first.unionByName(second)).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
