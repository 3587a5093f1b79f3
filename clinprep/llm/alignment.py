"""Cross-tokenizer alignment, with corpus counts of linked token pairs under a minimal perfect hash.

Two tokenizers cut the same bytes. Tokens whose byte ranges overlap are linked, and the offsets where both end cut a
text into groups. The first pass over the documents gathers, for each task, the distinct (A id, B id) pairs of its links
with their counts. The distinct pairs of all tasks are dealt out by hash into PARTS parts, and each part gets a
minimal perfect hash of its own: levels of bit arrays in which a pair that is alone at its place sets a bit, while the others go on
to the next level; the rank of its bit is the pair's number. The numbers of the parts follow one another. Tasks then add their counts
into dense vectors indexed by that number, and slices of the vectors are summed in a tree. The second pass aligns the
documents again and looks the counts up; the stored pair at a number tells whether it is the one that was asked for.

What tasks need of the hash is broadcast in rounds of ROUND_BYTES at most, each for some of the parts: sums over links are sums over parts.

Both tokenizers work on stretches of a text that begin with a space after another character, one by one: neither has a
token that goes on over such a place (``split_safe`` tells), so each distinct stretch is encoded once a task.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import small_batches, table
from clinprep.sources.shared import store

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts of the distinct pairs. With two vocabularies below 65,536 a part holds 2^32 / PARTS pairs at the very most.
PARTS = 1024
#: Distinct stretches, and their characters, that a task remembers; characters of the documents that it takes at a time.
STRETCHES, STRETCH_CHARS, CHARS = 400_000, 16_000_000, 2_000_000
#: Stretches that are placed together, and that A encodes as one text.
RUN, SHORT = 2_000, 100
#: Pairs of a part that are gathered before repeats go.
GATHERED = 4_000_000
#: Bytes of hash, pairs and counts that are broadcast at a time, and what a pair takes of them at most.
ROUND_BYTES, PAIR_BYTES = 64 << 20, 16
#: Counts in a slice of a dense vector, and vectors that are summed in a step of the tree.
SLICE, FAN = 1 << 16, 32
STRETCH = re.compile(r"(?<=\S) ")


@lru_cache(maxsize=4)
def byte_level(path: str) -> tuple[tokenizers.Tokenizer, list[bytes]]:
    """A byte-level tokenizer and the bytes of its tokens. The 256 letters that stand for bytes follow from a rule: printable
    ones stand for themselves, the others for the letters from 256 on, in their order."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return t, [bytes(letters[c] for c in t.id_to_token(i)) if set(t.id_to_token(i)) <= letters.keys() else t.id_to_token(i).encode() for i in range(t.get_vocab_size())]


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """A piece tokenizer and the bytes of its tokens."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    return p, [bytes([int(n[3:5], 16)]) if p.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def split_safe(path: str) -> bool:
    """Whether no piece has a space after another character, so that stretches can be encoded one by one."""
    return not any(b" " in x.lstrip(b" ") for x in pieces(path)[1])


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix, one to one for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) % np.uint64(PARTS)).astype(np.int64)


def perfect_levels(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """A minimal perfect hash of distinct keys: bits of each level, the levels' bit arrays, and the keys in the order of their numbers."""
    sizes, bits, order, left = [], [], [], keys
    while len(left):
        size = 64 * -(-2 * len(left) // 64)
        at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        n = np.bincount(at, minlength=size)
        alone = n[at] == 1
        sizes.append(size)
        bits.append(np.packbits(n == 1, bitorder="little").tobytes())
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    return sizes, b"".join(bits), np.concatenate(order) if order else keys


class PerfectHash:
    """The minimal perfect hash of some parts, given as rows (part, sizes, bits, keys) in the order of parts."""

    def __init__(self, rows: list):
        depth = max((len(r["sizes"]) for r in rows), default=0)
        self.sizes = np.zeros((depth, PARTS), np.int64)
        self.start = np.zeros(PARTS, np.int64)
        at = 0
        for r in rows:
            self.sizes[: len(r["sizes"]), r["part"]] = r["sizes"]
            self.start[r["part"]] = at
            at += sum(r["sizes"])
        self.bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint64)
        self.before = np.cumsum(np.bitwise_count(self.bits), dtype=np.int64) - np.bitwise_count(self.bits)
        self.keys = np.frombuffer(b"".join(bytes(r["keys"]) for r in rows), np.uint32)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that isn't held."""
        out, part, act = np.full(len(keys), -1, np.int64), part_of(keys), np.arange(len(keys))
        bit = self.start[part]
        for level, sizes in enumerate(self.sizes):
            act = act[sizes[part[act]] > 0]
            if not len(act):
                break
            size = sizes[part[act]]
            at = bit[act] + (mixed(keys[act], level) % size.astype(np.uint64)).astype(np.int64)
            word, below = self.bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> below) & np.uint64(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << below) - np.uint64(1)))
            out[act[found]] = rank[found]
            bit[act] += size
            act = act[~found]
        held = np.flatnonzero(out >= 0)
        out[held[self.keys[out[held]] != keys[held]]] = -1
        return out


@lru_cache(maxsize=2)
def _written(a_size: int, b_size: int) -> tuple[list[str], np.ndarray]:
    """Token ids as they stand in the text of groups: of A before another one and before B's, of B before another one, before the next group
    and at the end; and the lengths of these texts."""
    texts = [f"{i}{end}" for size, ends in ((a_size, ",|"), (b_size, [",", ";", ""])) for end in ends for i in range(size)]
    return texts, np.array([len(t) for t in texts], np.int64)


class Stretches:
    """Aligned stretches of texts, by number: tokens of A and B, groups, links and their pairs; with a look-up, what it gave and the groups' texts."""

    def __init__(self, a_path: str, b_path: str, look=None):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = byte_level(a_path), pieces(b_path)
        self.a_len, self.b_len = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.space = [self.b.piece_to_id("▁")]
        self.whole = not split_safe(b_path)
        self.look = look
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.n = self.chars = 0
        #: tokens of A, of B, groups, links, and of the links: those at their B id's highest count, the sum of counts
        self.numbers = np.zeros((0, 6), np.int64)
        self.added: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def full(self) -> bool:
        return len(self.place) > STRETCHES or self.chars > STRETCH_CHARS

    def _add(self, new: list[str]) -> None:
        """Encode stretches: as running text, many at once, where each ends in what is no space and so leaves the next one alone."""
        self.chars += sum(map(len, new))
        running = [s for s in new if s and not s[-1].isspace()]
        for lo in range(0, len(running), RUN):
            some = running[lo : lo + RUN]
            texts = [" " + " ".join(some[at : at + SHORT]) for at in range(0, len(some), SHORT)]
            text = "".join(texts)
            a = [i for e in self.a.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids]
            b = self.b.encode(text[1:])
            if not self._given(text, a, b) or not self._placed(some, a, b):
                self._single(some)
        self._single([s for s in new if not s or s[-1].isspace()])

    def _single(self, new: list[str]) -> None:
        for s in new:
            a, b = self.a.encode(" " + s, add_special_tokens=False).ids, self.b.encode(s) or self.space
            if not self._given(" " + s, a, b) or not self._placed([s], a, b):
                self.place[s] = -1

    def _given(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether both give the text back."""
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def _placed(self, new: list[str], a: list[int], b: list[int]) -> bool:
        """Number the stretches of a text; False if a token goes on over the end of one."""
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.cumsum([len(s.encode()) + 1 for s in new])
        a_last, b_last = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        if (a_end[a_last] != ends).any() or (b_end[b_last] != ends).any():
            return False
        n_a, n_b = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        first, last = np.searchsorted(b_end, a_end - self.a_len[a], "right"), np.searchsorted(b_end, a_end)
        n = last - first + 1
        linked = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = (np.repeat(a, n) << 16 | b[linked]).astype(np.uint32)
        starts, a_cut = a_last + 1 - n_a, b_end[last] == a_end
        links, groups = np.add.reduceat(n, starts), np.add.reduceat(a_cut.astype(np.int64), starts)
        best, total = np.zeros((2, len(new)), np.int64)
        if self.look:
            at = np.cumsum(links) - links
            best, total = (np.add.reduceat(x, at) for x in self.look(pairs))
            self.groups += self._texts(a, b, a_cut, a_end[np.minimum(np.searchsorted(a_end, b_end), len(a) - 1)] == b_end, b_last, np.cumsum(n_a + n_b))
        self.place.update(zip(new, range(self.n, self.n + len(new)), strict=True))
        self.n += len(new)
        self.added.append(np.stack([n_a, n_b, groups, links, best, total], 1))
        self.pairs.append(pairs)
        return True

    def _texts(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, b_last: np.ndarray, upto: np.ndarray) -> list[str]:
        """The groups of each stretch: A's ids, B's ids. Tokens are put in the order of groups, in each A's first, with what follows them."""
        sizes = len(self.a_bytes), len(self.b_bytes)
        texts, lengths = _written(*sizes)
        end = b_cut.astype(np.int64)
        end[b_last] = 2
        codes = np.r_[a + a_cut * sizes[0], 2 * sizes[0] + b + end * sizes[1]]
        group = np.r_[2 * (np.cumsum(a_cut) - a_cut), 2 * (np.cumsum(b_cut) - b_cut) + 1]
        codes = codes[np.argsort(group, kind="stable")]
        whole = "".join([texts[c] for c in codes.tolist()])
        cuts = np.r_[0, np.cumsum(lengths[codes])[upto - 1]].tolist()
        return [whole[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def settled(self) -> np.ndarray:
        """The numbers of all stretches."""
        if self.added:
            self.numbers = np.concatenate([self.numbers, *self.added])
            self.added = []
        return self.numbers

    def numbered(self, texts: list[str | None]) -> list[np.ndarray]:
        """The stretches of each text in their order; none where a text has no tokens."""
        cut = [([t] if self.whole else STRETCH.split(t)) if t else [] for t in texts]
        new = {s for ss in cut for s in ss} - self.place.keys()
        if new:
            self._add(sorted(new))
        out = []
        for t, ss in zip(texts, cut, strict=True):
            at = np.fromiter(map(self.place.__getitem__, ss), np.int64, len(ss))
            if len(at) and at.min() < 0:  # some stretch is not given back: the text is, or has no tokens
                if t not in self.place:
                    self._single([t])
                at = np.array([self.place[t]] if self.place[t] >= 0 else [], np.int64)
            out.append(at)
        return out


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Rows of a batch of about CHARS characters at a time, with their texts."""
    for batch in batches:
        texts, lo, chars = batch.column(column).to_pylist(), 0, 0
        for hi, t in enumerate(texts, 1):
            chars += len(t or "")
            if chars >= CHARS or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, chars = hi, 0


def _gather(a_path: str, b_path: str):
    """(part, keys, counts): the distinct pairs of a task's links, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Stretches(a_path, b_path), np.zeros(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            if not known.pairs:
                return
            times = np.repeat(seen, known.settled()[:, 3])
            keys, at = np.unique(np.concatenate(known.pairs)[times > 0], return_inverse=True)
            counts = np.bincount(at, times[times > 0]).astype(np.int64) if times.sum() < 1 << 52 else _exact(at, times[times > 0])
            part = part_of(keys)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
            some = np.flatnonzero(np.diff(cuts))
            mine = [order[cuts[p] : cuts[p + 1]] for p in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[m].tobytes() for m in mine], pa.binary()), pa.array([counts[m].tobytes() for m in mine], pa.binary())], ["part", "keys", "counts"])

        for _, texts in _slices(batches, 0):
            at = known.numbered(texts)
            seen = np.r_[seen, np.zeros(known.n - len(seen), np.int64)]
            seen += np.bincount(np.concatenate(at), minlength=len(seen))
            if known.full():
                yield from rows()
                known.clear()
                seen = np.zeros(0, np.int64)
        yield from rows()

    return run


def _exact(at: np.ndarray, times: np.ndarray) -> np.ndarray:
    out = np.zeros(at.max(initial=-1) + 1, np.int64)
    np.add.at(out, at, times)
    return out


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, n, sizes, bits, keys) of each part, from its rows (part, keys), which come together."""
    part, held, n = None, [], 0

    def row() -> pa.RecordBatch:
        keys = np.unique(np.concatenate(held))
        sizes, bits, order = perfect_levels(keys)
        cells = [pa.array([part], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sizes], pa.list_(pa.int64())), pa.array([bits], pa.binary()), pa.array([order.astype(np.uint32).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, ["part", "n", "sizes", "bits", "keys"])

    for batch in batches:
        for p, keys in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if p != part and held:
                yield row()
                held, n = [], 0
            part = p
            held.append(np.frombuffer(keys.as_buffer(), np.uint32))
            n += len(held[-1])
            if n > GATHERED + 2 * len(held[0]):
                held = [np.unique(np.concatenate(held))]
                n = len(held[0])
    if held:
        yield row()


SUMS = "slice int, leg int, counts binary"


def _dense(sent):
    """(slice, leg, counts): slices of the task's dense vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total, leg = sent.value, None, 0
        for batch in batches:
            for keys, counts, leg in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                total = np.zeros(len(found.keys), np.int64) if total is None else total
                at = found.numbers(np.frombuffer(keys.as_buffer(), np.uint32))
                total[at] += np.frombuffer(counts.as_buffer(), np.int64)  # the keys of a row are distinct, and all are held
        if total is not None:
            some = [s for s in range(0, len(total), SLICE) if total[s : s + SLICE].any()]
            cells = [[s // SLICE for s in some], [leg] * len(some), [total[s : s + SLICE].tobytes() for s in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["slice", "leg", "counts"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of each (slice, leg), which come together."""
    at, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "leg", "counts"])
    for batch in batches:
        for s, leg, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if at is not None and at != (s, leg):
                yield row()
                total = None
            at, more = (s, leg), np.frombuffer(counts.as_buffer(), np.int64)
            total = more.copy() if total is None else total + more
    if at is not None:
        yield row()


def tree_sum(sums: DataFrame) -> DataFrame:
    """Slices of dense vectors summed over their legs, FAN legs a step, until one is left."""
    sums = store(sums, "dense-sums")
    while sums.agg(F.max("leg")).first()[0]:
        sums = sums.withColumn("leg", F.floor(F.col("leg") / FAN).cast("int")).repartition("slice", "leg").sortWithinPartitions("slice", "leg")
        sums = store(sums.mapInArrow(_added, SUMS), "dense-sums")
    return sums


class PairCounts:
    """The corpus counts of linked pairs, as tables in the shared folder, read in rounds of bounded bytes."""

    def __init__(self, docs: DataFrame, text_col: str, a_path: str, b_path: str, round_bytes: int):
        self.spark = docs.sparkSession
        gathered = docs.select(F.col(text_col).cast("string")).mapInArrow(_gather(a_path, b_path), "part int, keys binary, counts binary")
        self.pairs = store(gathered, "linked-pairs")
        self.parts = store(self.pairs.select("part", "keys").repartition("part").sortWithinPartitions("part").mapInArrow(_functions, "part int, n long, sizes array<bigint>, bits binary, keys binary"), "pair-hash")
        self.rounds, size = [], 0
        for r in self.parts.select("part", "n").orderBy("part").collect():  # PARTS rows at most
            if not self.rounds or size + r["n"] * PAIR_BYTES > round_bytes:
                self.rounds.append((r["part"], r["part"]))
                size = 0
            self.rounds[-1] = (self.rounds[-1][0], r["part"])
            size += r["n"] * PAIR_BYTES
        self.sums = []
        for at in self.rounds:
            sent = self.spark.sparkContext.broadcast(self.hash(at))
            mine = self.pairs.filter(F.col("part").between(*at)).select("keys", "counts", F.spark_partition_id().alias("leg"))
            self.sums.append(tree_sum(mine.mapInArrow(_dense(sent), SUMS)))
            sent.destroy()

    def hash(self, at: tuple[int, int]) -> PerfectHash:
        return PerfectHash(self.parts.filter(F.col("part").between(*at)).orderBy("part").collect())  # a round's bytes

    def counts(self, i: int, n: int) -> np.ndarray:
        """The dense vector of a round."""
        out = np.zeros(n, np.int64)
        for r in self.sums[i].select("slice", "counts").collect():
            some = np.frombuffer(bytes(r["counts"]), np.int64)
            out[r["slice"] * SLICE : r["slice"] * SLICE + len(some)] = some
        return out

    def highest(self) -> np.ndarray:
        """The highest count of a pair of each B id."""
        best = np.zeros(1 << 16, np.int64)
        for i, at in enumerate(self.rounds):
            keys = self.hash(at).keys
            np.maximum.at(best, keys & 0xFFFF, self.counts(i, len(keys)))
        return best

    def table(self) -> DataFrame:
        """(a_id, b_id, n) of every linked pair, from the sums that tasks left."""
        def run(batches):
            for batch in batches:
                for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                    k = np.frombuffer(keys.as_buffer(), np.uint32)
                    yield pa.RecordBatch.from_arrays([pa.array((k >> 16).astype(np.int32)), pa.array((k & 0xFFFF).astype(np.int32)), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], ["a_id", "b_id", "n"])

        return self.pairs.select("keys", "counts").mapInArrow(run, "a_id int, b_id int, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))


ALIGNED = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(a_path: str, b_path: str, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, counts, highest = sent.value

        def look(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = found.numbers(pairs)
            n = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(pairs), np.int64)
            return ((at >= 0) & (n == highest[pairs & 0xFFFF])).astype(np.int64), n

        known = Stretches(a_path, b_path, look)
        for batch, texts in _slices(batches, 2):
            at = known.numbered(texts)
            ends = np.cumsum([len(x) for x in at])
            upto = np.r_[np.zeros((1, 6), np.int64), np.cumsum(known.settled()[np.concatenate(at)], axis=0)]
            sums = upto[ends] - upto[ends - [len(x) for x in at]]
            shas = [hashlib.sha256(";".join([known.groups[i] for i in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in sums.T), pa.array(shas, pa.string())], [c.split()[0] for c in ALIGNED.split(", ")])
            if known.full():
                known.clear()

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A byte-level tokenizer (A) encodes a space and the text, a piece tokenizer (B), which adds the space itself, the text. Links are the A-B
    token pairs whose byte ranges overlap; n_best of them have the highest count that a pair of their B id has in the corpus,
    ties included, and count_sum is the sum of their pairs' counts. groups_sha256 hashes the ids of all groups.
    A null or empty text, and one that either tokenizer does not give back byte for byte, has no tokens, zeros, and ''.
    Repeated rows count as often as they stand; null and repeated ids come back as they are; an empty table gives an
    empty result. Other columns are ignored. Both vocabularies must be below 65,536.
    """
    a_path, b_path = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    spark = docs.sparkSession
    small_batches(spark)
    found = PairCounts(docs, text_col, a_path, b_path, round_bytes)
    highest = found.highest()
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rounds = found.rounds or [(0, 0)]
    if len(rounds) > 1:
        base = store(base, "numbered")  # the rows of all rounds meet by number
    parts = []
    for i, at in enumerate(rounds):
        hashed = found.hash(at)
        sent = spark.sparkContext.broadcast((hashed, found.counts(i, len(hashed.keys)) if found.sums else np.zeros(0, np.int64), highest))
        part = base.mapInArrow(_look_up(a_path, b_path, sent), ALIGNED)
        if len(rounds) == 1:
            return part.drop("row_id")
        parts.append(store(part, "aligned"))
        sent.destroy()
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return whole.groupBy("row_id").agg(*[F.first(c).alias(c) for c in same], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups_sha256").alias("groups_sha256")).drop("row_id")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``documents``.

    Null and empty texts, and texts that a tokenizer does not give back, have zeros and ''; repeated rows count each time; an
    empty table gives no rows.
    """
    return align(table(spark, sf_dir, "documents"))
