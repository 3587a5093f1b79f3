"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into segments placed on a ring, each with a budget of differing bits. If two
fingerprints differ in no more bits than allowed, some segment starts a chain of consecutive segments in
which, after every step, the differences so far stay within the budgets so far (the pigeonring
principle, in its integer form: the budgets sum to the allowed bits less the segments plus 1, and each
step of a chain but the first has one bit more). Candidates meet in the buckets of such a first segment:
a fingerprint is at home in the buckets within half the segment's budget and probes those within the other half.
Pairs that break the chain are dropped before the full Hamming check, which is the chain's last step.

Equal fingerprints are one class, represented by its smallest id. A task answers with a spanning forest of
the links it finds, never with all pairs of a group. A bucket with very many fingerprints is dealt out over a grid:
its homes and its probes fall into blocks of a bounded size by hash, and every two blocks that have to meet do so under a
key of their own, so no key holds more than two blocks. Components of the classes come from a distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.graph import Forest, components
from clinprep.llm.text import small_batches, table
from clinprep.sources.shared import store

#: Candidate pairs looked at at once in a task.
PAIRS = 1_000_000
#: Rows of sorted buckets that a task takes at a time.
ROWS = 100_000
#: Homes or probes of a bucket before it is dealt out in blocks of this size; BLOCKS a side at most, then blocks grow.
HOT_HOMES, BLOCKS = 8_192, 1_024
#: What a row does in its bucket: meets all rows after it, meets the guests only, is a guest (rows are in this order).
HOME, HOST, GUEST = 0, 1, 2
#: A key is the segment, its value (32 bits), and the cell of the grid (GRID bits).
GRID = 21

WIDTHS, BUDGETS = (22, 21, 21), (0, 1, 1)  # 4 bits of 64


def shingle_hashes(text: bytes, words: int, lanes: int = 1) -> list[np.ndarray]:
    """XXH64 of the word shingles in their order, repeats included, a lane for each of the seeds 42, 43, ...; no words: none."""
    w = text.lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    return [np.fromiter((xxhash.xxh64_intdigest(s, 42 + lane) for s in shingles), np.uint64, len(shingles)) for lane in range(lanes)]


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes set, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def fingerprint(text: bytes, words: int, lanes: int = 1) -> tuple[int, ...]:
    """64 bits a lane; a text without words has zeros."""
    return tuple(majority(h) for h in shingle_hashes(text, words, lanes))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, lanes: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...): a row for each input row; null texts count as empty."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprint(t.encode(), words, lanes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(lanes))], ["doc_id", *names])

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


class Ring:
    """Segments of a fingerprint of 64 or more bits, with their budgets."""

    def __init__(self, bits: int, widths: tuple[int, ...] = WIDTHS, budgets: tuple[int, ...] = BUDGETS):
        lanes, used = [[]], 0
        for w in widths:  # no segment crosses a lane
            lanes[-1].append(w)
            used += w
            if used == 64:
                lanes.append([])
                used = 0
        if used or lanes.pop() or sum(budgets) != bits - len(widths) + 1:
            raise ValueError("segments must fill lanes of 64 bits and budgets must sum to bits - segments + 1")
        self.bits, self.budgets, self.lanes = bits, budgets, len(lanes)
        self.parts = [(lane, 64 - sum(ws[: k + 1]), w) for lane, ws in enumerate(lanes) for k, w in enumerate(ws)]
        # (segment, flipped bits of it, whether at home): a budget is met half way, odd ones by probes
        self.entries = [
            (s, sum(1 << b for b in flip), n <= budgets[s] // 2)
            for s, (_, _, w) in enumerate(self.parts)
            for n in range((budgets[s] + 1) // 2 + 1)
            for flip in combinations(range(w), n)
        ]

    def segment_bits(self, xor: list[np.ndarray], s: int) -> np.ndarray:
        lane, shift, width = self.parts[s]
        return np.bitwise_count((xor[lane] >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int16)

    def linked(self, xor: list[np.ndarray], start: int) -> np.ndarray:
        """The pairs that keep the chain from segment ``start`` and the full Hamming bound."""
        m, alive = len(self.parts), np.arange(len(xor[0]))
        spent, allowed = np.zeros(len(alive), np.int16), -1
        for step in range(m):
            s = (start + step) % m
            spent = spent + self.segment_bits(xor, s)
            allowed += self.budgets[s] + 1
            ok = np.flatnonzero(spent <= allowed)
            alive, spent, xor = alive[ok], spent[ok], [x[ok] for x in xor]
        return alive  # after the whole ring, allowed is self.bits: this was the full check

    def near(self, xor: list[np.ndarray]) -> np.ndarray:
        """The pairs that keep a chain from some segment, and so the full Hamming bound."""
        found = np.zeros(len(xor[0]), bool)
        for s in range(len(self.parts)):
            rest = np.flatnonzero(~found)
            found[rest[self.linked([x[rest] for x in xor], s)]] = True
        return np.flatnonzero(found)


def parts(ring: Ring) -> Column:
    """The fingerprint's segments: structs of (segment, value)."""
    value = lambda lane, shift, w: F.expr(f"shiftrightunsigned(f{lane}, {shift}) & {(1 << w) - 1}L")
    return F.array(*[F.struct(F.lit(s).alias("segment"), value(*part).alias("value")) for s, part in enumerate(ring.parts)])


def _flips(ring: Ring, segment: Column) -> Column:
    """Where a fingerprint goes by one segment: structs of (flip, home)."""
    by_segment = [F.array(*[F.struct(F.lit(flip).cast("long").alias("flip"), F.lit(home).alias("home")) for s, flip, home in ring.entries if s == at]) for at in range(len(ring.parts))]
    return F.element_at(F.array(*by_segment), segment + 1)


def _grid(homes: Column, probes: Column, own: Column, probe: Column) -> Column:
    """The cells of a hot bucket that a row visits, with what it does there. Blocks of homes meet one another in cells
    (smaller, larger) and blocks of probes in a second family of cells."""
    cell = lambda at, kind: F.struct(at.cast("long").alias("cell"), kind.cast("int").alias("kind"))
    met = lambda at: (F.lit(1 << 20) + at)
    among = F.transform(F.sequence(F.lit(0), homes - 1), lambda j: cell(F.least(own, j) * BLOCKS + F.greatest(own, j), F.when(own == j, HOME).when(own < j, HOST).otherwise(GUEST)))
    hosting = F.when(probes > 0, F.transform(F.sequence(F.lit(0), probes - 1), lambda p: cell(met(own * BLOCKS + p), F.lit(HOST)))).otherwise(F.array().cast("array<struct<cell:bigint,kind:int>>"))
    visiting = F.transform(F.sequence(F.lit(0), homes - 1), lambda h: cell(met(h * BLOCKS + own), F.lit(GUEST)))
    return F.when(probe, visiting).otherwise(F.concat(among, hosting))


def buckets(classes: DataFrame, ring: Ring) -> DataFrame:
    """(key, kind, rep, f0, ...): where each class meets others, sorted within partitions by key and kind."""
    names = [f"f{i}" for i in range(ring.lanes)]
    parted = classes.select("rep", *names, F.explode(parts(ring)).alias("p")).select("*", "p.segment", "p.value").drop("p")
    whole = lambda df: df.select("*", F.explode(_flips(ring, F.col("segment"))).alias("e")).withColumn("bucket", F.col("segment").cast("long") * (1 << 32) + F.col("value").bitwiseXOR(F.col("e.flip"))).withColumn("probe", ~F.col("e.home"))
    # sizes of buckets from the counts of distinct segment values
    sizes = whole(parted.groupBy("segment", "value").count()).groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("probe") == p, F.col("count"))), F.lit(0)).alias(n) for n, p in (("homes", False), ("probes", True))])
    blocks = lambda c: F.least(F.ceil(F.col(c) / HOT_HOMES), F.lit(BLOCKS)).cast("int").alias(c)
    hot = store(sizes.filter(F.greatest("homes", "probes") > HOT_HOMES).select("bucket", blocks("homes"), blocks("probes")), "hot-buckets")
    keyed = whole(parted).select("bucket", "probe", "rep", *names)
    dealt = keyed.join(hot, "bucket", "left")
    own = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.when(F.col("probe"), F.col("probes")).otherwise(F.col("homes")))).cast("int")
    plain = F.array(F.struct(F.lit(0).cast("long").alias("cell"), F.when(F.col("probe"), GUEST).otherwise(HOME).cast("int").alias("kind")))
    cells = F.when(F.col("homes").isNull(), plain).when(F.col("homes") > 0, _grid(F.col("homes"), F.col("probes"), own, F.col("probe")))  # without homes there is nothing to meet
    dealt = dealt.select("bucket", "rep", *names, F.explode(cells).alias("c")).select((F.col("bucket") * (1 << GRID) + F.col("c.cell")).alias("key"), "c.kind", "rep", *names)
    return dealt.repartition("key").sortWithinPartitions("key", "kind")


def whole_keys(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[list[np.ndarray]]:
    """The columns of some rows at a time; rows are sorted by the first column, and rows of one value come together."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            some = pa.Table.from_batches(held)
            key = some.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield [c.to_numpy() for c in some.slice(0, last).columns]
            held, n = some.slice(last).combine_chunks().to_batches(), some.num_rows - last
    if n:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).columns]


def meetings(key: np.ndarray, kind: np.ndarray, size: np.ndarray | None = None, share: int = 1, of: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segment, i, j): the pairs of rows that meet in whole buckets, at most PAIRS at once. Given sizes, only those
    whose smaller size is at least share / of of the larger."""
    bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64)
    size = np.zeros(len(key), np.int64) if size is None else size.astype(np.int64)
    at = ((bucket * 4 + kind) << 32) + size
    least, most = -(-size * share // of), size * of // share
    homes, hosts = np.flatnonzero(kind == HOME), np.flatnonzero(kind != GUEST)
    others, guests = (bucket * 4 + HOME) << 32, (bucket * 4 + GUEST) << 32
    spans = [
        (homes, homes + 1, np.searchsorted(at, (others + most)[homes], "right")),
        (hosts, np.searchsorted(at, (guests + least)[hosts]), np.searchsorted(at, (guests + most)[hosts], "right")),
    ]
    for rows, start, stop in spans:
        segment = key[rows] >> (32 + GRID)
        cuts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]) if len(rows) else [0]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            done = np.r_[0, np.cumsum(stop[lo:hi] - start[lo:hi])]
            for first in range(0, int(done[-1]), PAIRS):
                n = np.arange(first, min(first + PAIRS, int(done[-1])))
                w = np.searchsorted(done, n, "right") - 1
                yield int(segment[lo]), rows[lo + w], start[lo + w] + n - done[w]


def _links(ring: Ring):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for key, kind, rep, *words in whole_keys(batches):
            words = [w.view(np.uint64) for w in words]
            for segment, i, j in meetings(key, kind):
                ok = ring.linked([w[i] ^ w[j] for w in words], segment)
                forest.link(rep[i[ok]], rep[j[ok]])
            if forest.full():
                yield forest.drain()
        yield forest.drain()

    return run


def near_components(prints: DataFrame, ring: Ring) -> DataFrame:
    """(doc_id, f0, ..., component_id): fingerprints within ring.bits are linked; the smallest id reachable names a component.

    Rows with a null id come back with a null component. Rows that repeat an id are one document, linked to all that any of
    its fingerprints is near.
    """
    names = [f"f{i}" for i in range(ring.lanes)]
    prints = store(prints, "fingerprints")
    classes = store(prints.filter("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("rep")), "classes")
    names_of = store(classes, "class-reps")
    edges = buckets(classes, ring).mapInArrow(_links(ring), "a long, b long")
    # an id with several fingerprints links their classes
    print_of = F.struct(*names)
    several = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min(print_of).alias("lo"), F.max(print_of).alias("hi")).filter("lo <> hi").select("doc_id")
    own = store(prints.join(several, "doc_id", "left_semi").join(names_of, names).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "own-classes")
    found = components(edges.unionByName(own))
    labelled = names_of.join(found, names_of["rep"] == found["node"], "left").select(*[F.col(n).alias(f"c_{n}") for n in names], F.coalesce("component", "rep").alias("component_id"))
    labelled = store(labelled, "class-components")
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"c_{n}"))
    return prints.join(labelled, same, "left").select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, ring: Ring | None = None) -> DataFrame:
    """(doc_id, f0, ..., component_id) of every row; see fingerprints and near_components.

    Null texts count as empty; texts without words have fingerprint 0 and link like any others.
    An empty table gives an empty result. Other columns are ignored.
    """
    ring = ring or Ring(4)
    return near_components(fingerprints(docs, id_col, text_col, words, ring.lanes), ring)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``documents``: 4-word shingles, 4 bits of 64.

    Null and empty texts have fingerprint zero and link like any others; copies share a component. A row with a null id
    has a null component, a repeated id comes back once a row, an empty table gives no rows.
    """
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
