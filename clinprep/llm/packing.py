"""Packing by shortest-pack-first over the length histogram.

Only a histogram of piece lengths (at most one row for each length up to the context) reaches the driver. Lengths
are placed longest first: each goes to the shortest packs that it fits, a pattern and its count at a time, and
opens new packs when it fits none. A pack takes several pieces of one length at once where more are left than packs
(new packs are filled with them), so that a corpus of equal lengths fills its packs too. The resulting patterns are
intervals of ranks for each length; each piece gets its rank within its length in a distributed way and finds its pack
in the interval that holds it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import positions, small_batches, table
from clinprep.sources.shared import store

VOCABULARY = "word_bpe_49k.json"
CONTEXT = 4096
END = 2
#: Encoded words that a Python worker remembers, from task to task, before it starts anew.
REMEMBER = 800_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


STOPS = (b".", b",")
#: A capital letter before a combining mark (all of them start with a byte of 0xCC or more): NFC may compose the two.
COMPOSED = re.compile(rb"[A-Z][\xcc-\xff]")
#: The steps of a tokenizer whose words can be encoded one by one, and its pattern of pieces.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_white_space(path: str) -> bool:
    """True if the tokenizer of this file composes and lower-cases a text and makes every word's pieces by themselves."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    kinds = [step["type"] for step in steps]
    return kinds == NORMALIZERS and steps[1]["pattern"] == {"Regex": "\\s+"} and first.get("pattern") == {"Regex": PIECE} and first.get("invert") is True


class WordEncoder:
    """The ids of a text as little-endian unsigned 32-bit integers.

    A tokenizer that drops white space gives a text the ids of its words (cut at ASCII white space) end to end;
    words are encoded in batches and remembered in lower case. That may change the ids of added tokens, which are looked
    for in the raw text, and of capitals that are composed; a text with either keeps all but its plain ASCII words. A stop or comma after a letter or digit is always a piece of its own,
    so such words are made of two remembered ones. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        self.path, self.known = path, {}
        self.by_word = drops_white_space(path)

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain, rest = [], []
        for w, text in zip(words, texts, strict=True):
            (plain if text.isalpha() else rest).append((w, text))
        if plain:
            # words of letters are one piece each, so one text of them all tells them apart as well, and faster
            found = tokenizer(self.path).encode(" ".join([text for _, text in plain]), add_special_tokens=False)
            if not self._remember(plain, found, True):
                rest += plain
        if rest:
            self._remember(rest, tokenizer(self.path).encode([text for _, text in rest], is_pretokenized=True, add_special_tokens=False))

    def _remember(self, words: list[tuple[bytes, str]], found, one_each: bool = False) -> bool:
        """False, and nothing remembered, if each word should be one piece and is not."""
        which = np.asarray(found.word_ids, np.int64)
        if one_each and which[-1] != len(words) - 1:
            return False
        ids = np.asarray(found.ids, "<u4").tobytes()
        cut = (np.searchsorted(which, np.arange(len(words) + 1)) * 4).tolist()
        self.known.update((w, ids[cut[i] : cut[i + 1]]) for i, (w, _) in enumerate(words))
        return True

    def words(self, text: str) -> list[bytes]:
        raw = text.encode()
        if b"<|" not in raw and (raw.isascii() or COMPOSED.search(raw) is None):
            return raw.lower().split()
        return [w.lower() if w.isascii() and b"<|" not in w else w for w in raw.split()]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            found = tokenizer(self.path).encode_batch(texts, add_special_tokens=False)
            return [np.asarray(f.ids, "<u4").tobytes() for f in found]
        if len(self.known) > REMEMBER:
            self.known = {}
        split = [self.words(t) for t in texts]
        known, missing = self.known, {}
        for words in split:
            for w in words:
                if w not in known:
                    missing[w] = None
        stopped = [w for w in missing if w[-1:] in STOPS and w[-2:-1].isalnum()]
        for w in stopped:
            del missing[w]
        for w in stopped:
            missing.update((part, None) for part in (w[:-1], w[-1:]) if part not in known)
        missing = list(missing)
        for at in range(0, len(missing), 4096):
            self.learn(missing[at : at + 4096])
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in stopped)
        return [b"".join([known[w] for w in words]) for words in split]


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, context: int = CONTEXT, end: int = END) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): each text's ids and an end id, cut into pieces of at most ``context`` ids.

    ids are little-endian unsigned 32-bit integers. A null or empty text is one piece that holds the end id. Null and
    repeated ids are kept as they stand. Other columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, step = word_encoder(path), np.uint32(end).astype("<u4").tobytes(), 4 * context
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    ids += last
                    rows += [(doc_id, lo // 4, min(step, len(ids) - lo) // 4, len(ids) // 4, ids[lo : lo + step]) for lo in range(0, len(ids), step)]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, PIECES)


def shortest_pack_first(histogram: dict[int, int], context: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns and their counts: (packs, ((length, how often in a pack), ...)), lengths falling within a pattern."""
    open_packs: list[tuple[int, int, int, tuple]] = []  # (tokens, order, packs, items), shortest first
    done, order = [], 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        put = []
        while left:
            if open_packs and open_packs[0][0] + length <= context:
                used, _, packs, items = heappop(open_packs)
                times = min((context - used) // length, max(1, left // packs))
                take = min(packs, left // times)
                if take < packs:
                    order += 1
                    heappush(open_packs, (used, order, packs - take, items))
            else:
                used, items, times, take = 0, (), 1, left
                fit = context // length
                if fit > 1:  # a pack may take several of this length
                    times = min(fit, left)
                    take = left // times
            left -= take * times
            put.append((used + times * length, take, (*items, (length, times))))
        for used, take, items in put:
            if used == context:
                done.append((take, items))
            else:
                order += 1
                heappush(open_packs, (used, order, take, items))
    return done + [(packs, items) for _, _, packs, items in open_packs]


def pack(pieces: DataFrame, context: int = CONTEXT) -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset`` (the place of the piece in its sequence).

    Needs doc_id, start and length (1 to context); all further columns are kept. Ties and repeated rows get
    places of their own. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    # stored with a number of its own, so that pieces that agree in all else are spread too
    pieces = store(pieces.withColumn("piece_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `context` rows
    patterns = shortest_pack_first(counts, context)
    rows, first, used = [], 0, dict.fromkeys(counts, 0)
    for packs, items in patterns:
        offset = 0
        for length, times in items:
            lo = used[length]
            used[length] = lo + packs * times
            rows.append((length, lo, used[length], first, times, offset))
            offset += length * times
        first += packs
    # the number of intervals follows from the context alone, not from the number of pieces
    names = ["p_length", "lo", "hi", "first", "times", "at"]
    intervals = F.broadcast(spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})))
    spread = F.shiftrightunsigned(F.xxhash64("piece_row"), 24)
    ranked = positions(pieces.withColumn("spread", spread), ["length"], [F.col("spread"), F.col("piece_row")], "rank").drop("spread")
    inside = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    nth = F.col("rank") - F.col("lo")
    return (
        ranked.join(intervals, inside)
        .withColumn("sequence_id", F.col("first") + F.expr("(rank - lo) div times"))
        .withColumn("offset", F.col("at") + nth % F.col("times") * F.col("length"))
        .drop(*names, "rank", "piece_row")
    )


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Pieces of documents with the CRC-32 of their ids and their places; ids themselves are left out."""
    pieces = token_pieces(docs, id_col, text_col, **how).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces, how.get("context", CONTEXT))


def sequences(packed: DataFrame, context: int = CONTEXT, padding: int = 0) -> DataFrame:
    """(sequence_id, tokens array<int>, used): packed pieces with their ids put together and padded to the context."""
    end_to_end = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, used = [], []
            for parts in batch.column(1).to_pylist():
                ids = np.frombuffer(b"".join([p["ids"] for p in parts]), "<u4").astype(np.int32)
                used.append(len(ids))
                tokens.append(np.r_[ids, np.full(context - len(ids), padding, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int32())), pa.array(used, pa.int64())], ["sequence_id", "tokens", "used"])

    return end_to_end.mapInArrow(run, "sequence_id long, tokens array<int>, used long")


def crc32_of(ids: list[int]) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of ``documents``, in sequences of 4096 tokens.

    A null or empty text is one piece with the end id; pieces of equal length and repeated rows have places of their own; an empty
    table gives no rows.
    """
    out = packed_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
