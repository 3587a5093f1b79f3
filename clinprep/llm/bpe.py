"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

A block of documents is cut into pre-tokens; it becomes a dictionary of its distinct words and, for every
position of every document, the word's place in that dictionary. Only dictionaries travel: exploded
by parts of the vocabulary (a word's part is its hash), all blocks' words of a part meet in one task, which encodes each
distinct word once for the whole corpus, and the ids join back to their block, where documents are reassembled by
position. The positions themselves stay in a written table bucketed by block, so the join back moves
dictionaries only, compressed. A word comes at most once a block, however often the corpus holds it. Decoding joins the
table of token bytes, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinprep.llm.text import small_batches, table
from clinprep.sources.shared import shuffle_partitions, store_bucketed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A block ends with the document that brings it to so many characters.
BLOCK_CHARS = 9_000_000
#: The vocabulary is dealt out in so many parts for each shuffle partition.
PARTS_A_TASK = 4


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, token): the bytes of every id from 0 to the largest rank, null for a rank that no token has."""
    found = {rank: token for token, rank in ranks(path).items()}
    ids = range(max(found, default=-1) + 1)
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int32()), "token": pa.array(map(found.get, ids), pa.binary())}))


CHUNK = pa.struct([("part", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])
BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("places", pa.binary()), ("order", pa.binary()), ("chunks", pa.list_(CHUNK))])
BLOCKS_DDL = "block long, doc_ids array<long>, lengths array<int>, places binary, order binary, chunks array<struct<part: int, sizes: binary, words: binary>>"


def _blocks(pattern: str, parts: int):
    """places: each position's word, the most frequent first, as byte planes. order: those words by their part of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, squeeze = regex.compile(pattern).findall, zstandard.ZstdCompressor(level=3).compress
        places, ids, lengths, seen, chars, first = [], [], [], {}, 0, None

        def block() -> pa.RecordBatch:
            packed, words = np.concatenate(places), list(seen)
            by_count = np.argsort(-np.bincount(packed, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words))
            planes = rank[packed].astype("<u4").view(np.uint8).reshape(-1, 4).T  # small numbers: the higher planes vanish when compressed
            words = [words[i].encode() for i in by_count]
            part = np.fromiter((crc32(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable").astype(np.uint32)
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            chunks = []
            for p in np.flatnonzero(np.diff(cuts)):
                mine = [words[i] for i in order[cuts[p] : cuts[p + 1]]]
                chunks.append({"part": int(p), "sizes": np.fromiter(map(len, mine), np.uint32, len(mine)).tobytes(), "words": squeeze(b"".join(mine))})
            row = [[first], [ids], [lengths], [planes.tobytes()], [order.tobytes()], [chunks]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)

        for batch in batches:
            for row_id, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                first = row_id if first is None else first
                found = split(text)
                places.append(np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.uint32, len(found)))
                ids.append(doc_id)
                lengths.append(len(found))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield block()
                    places, ids, lengths, seen, chars, first = [], [], [], {}, 0, None
        if ids:
            yield block()

    return run


def _encode(path: str, pattern: str):
    """A task takes whole parts of the vocabulary, one at a time; each distinct word is encoded when it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, last = encoder(path, pattern).encode_ordinary, {}, None
        squeeze, expand = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at, part in enumerate(batch.column(1).to_pylist()):
                if part != last:  # rows are sorted by part, and no other part has its words
                    known, last = {}, part
                sizes, words = batch.column(2)[at].as_py(), expand(batch.column(3)[at].as_py())
                cut = np.r_[0, np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)].tolist()
                out = []
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    word = words[lo:hi]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.asarray(encode(word.decode()), np.uint16).tobytes()
                    out.append(ids)
                counts = squeeze(np.fromiter((len(x) // 2 for x in out), np.uint32, len(out)).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), batch.column(1).slice(at, 1), pa.array([counts], pa.binary()), pa.array([squeeze(b"".join(out))], pa.binary())], ["block", "part", "counts", "ids"])

    return run


ENCODED = "doc_id long, ids array<int>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for at in range(batch.num_rows):
            doc_ids, lengths, packed, order, coded = (batch.column(i)[at] for i in range(5))
            coded = sorted(coded.as_py(), key=lambda c: c["part"])
            flat = np.frombuffer(b"".join([expand(c["ids"]) for c in coded]), np.uint16)
            counts_by_order = np.frombuffer(b"".join([expand(c["counts"]) for c in coded]), np.uint32).astype(np.int64)
            order = np.frombuffer(order.as_py(), np.uint32)
            # each word's ids: where they begin and how many they are
            size, start = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            size[order], start[order] = counts_by_order, np.cumsum(counts_by_order) - counts_by_order
            docs, counts = doc_ids.values, lengths.values.to_numpy().astype(np.int64)
            where = np.ascontiguousarray(np.frombuffer(packed.as_py(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
            ends = np.cumsum(counts)
            lo = 0
            while lo < len(counts):  # documents of about a million words a batch
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 1_000_000)))
                w = where[ends[lo] - counts[lo] : ends[hi - 1]]
                n = size[w]
                upto = np.r_[0, np.cumsum(n)]
                ids = flat[np.repeat(start[w] - upto[:-1], n) + np.arange(upto[-1])]
                offsets = upto[np.r_[0, np.cumsum(counts[lo:hi])]]
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), values], ["doc_id", "ids"])
                lo = hi


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, a row for each input row.

    A null text counts as empty and has no ids; null and repeated ids are kept as they stand. Each match of
    ``pattern`` is encoded by itself, without special tokens. An empty table gives an empty result. Other
    columns are ignored. The ranks must lie below 65,536.
    """
    path, pattern = path or public_tokenizers.path(RANKS), pattern or public_tokenizers.PATTERN
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    tasks = shuffle_partitions(spark)
    blocks = base.mapInArrow(_blocks(pattern, PARTS_A_TASK * tasks), BLOCKS_DDL)
    blocks, _ = store_bucketed(blocks, "bpe_blocks", "block", tasks, sort=False)
    words = blocks.select("block", F.explode("chunks").alias("chunk")).select("block", "chunk.*")
    coded = words.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_encode(path, pattern), "block long, part int, counts binary, ids binary")
    back = coded.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "ids")).alias("coded"))
    joined = blocks.select("block", "doc_ids", "lengths", "places", "order").join(back, "block", "left")
    # a block of empty texts only has no words
    none = F.array().cast("array<struct<part: int, counts: binary, ids: binary>>")
    return joined.select("doc_ids", "lengths", "places", "order", F.coalesce("coded", none).alias("coded")).mapInArrow(_assemble, ENCODED)


def decode(encoded: DataFrame, ids_col: str = "ids", out: str = "bytes", path: str | None = None) -> DataFrame:
    """``encoded`` with the bytes of its ids in a further column ``out``, which replaces one of that name.

    The token-byte table joins as one broadcast row, an array by id, whose size is the vocabulary's; each id of a list
    finds its bytes there and they are put together in the order of the list. Null ids give null bytes, empty lists
    empty ones; an id that the table lacks has no bytes.
    """
    tokens = token_table(encoded.sparkSession, path or public_tokenizers.path(RANKS))
    by_id = tokens.agg(F.sort_array(F.collect_list(F.struct("id", "token"))).alias("all")).select(F.col("all.token").alias("_tokens"))
    names = encoded.columns
    numbered = encoded.toDF(*[f"_{i}" for i in range(len(names))])
    ids = F.col(f"_{names.index(ids_col)}")
    # texts are bytes to array_join: a token may end within a character
    found = F.array_join(F.transform(ids, lambda i: F.get("_tokens", i).cast("string")), "").cast("binary")
    kept = [(F.col(f"_{i}").alias(n)) for i, n in enumerate(names) if n != out]
    return numbered.join(F.broadcast(by_id)).select(*kept, found.alias(out))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``documents``.

    A null text is empty and has no ids; repeated rows and null ids come back as they stand; an empty table gives no rows.
    """
    out = decode(encode(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
