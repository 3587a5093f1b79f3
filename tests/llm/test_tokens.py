import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clinprep.llm import bpe, packing, sharding, topk
from clinprep.llm.text import positions

from .helpers import TEXTS, documents


def test_bpe_round_trip(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3_000)
    encoder = bpe.encoder(P.path(bpe.RANKS), P.PATTERN)
    got = sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in bpe.decode(bpe.encode(documents(spark))).collect()), key=repr)
    want = sorted(((i, encoder.encode_ordinary(t or ""), (t or "").encode()) for i, t in TEXTS), key=repr)
    assert got == want


def test_bpe_decoding_joins_by_id(spark):
    df = spark.createDataFrame([(1, [5, 300, 5], "b"), (2, [], None), (3, None, "b"), (4, [65_535, 7], "b")], "doc_id long, ids array<int>, bytes string")
    token = {rank: t for t, rank in bpe.ranks(P.path(bpe.RANKS)).items()}
    got = {r.doc_id: r.bytes if r.bytes is None else bytes(r.bytes) for r in bpe.decode(df).collect()}
    assert got == {1: token[5] + token[300] + token[5], 2: b"", 3: None, 4: token.get(65_535, b"") + token[7]}


def test_bpe_empty(spark):
    assert bpe.decode(bpe.encode(documents(spark, []))).count() == 0
    assert [list(r.ids) for r in bpe.encode(documents(spark, [(1, None), (2, "")])).collect()] == [[], []]


def test_pieces_match_the_tokenizer(spark):
    tok = packing.tokenizer(P.path(packing.VOCABULARY))
    ids = defaultdict(list)
    for i, t in TEXTS:
        ids[i].append(tok.encode(t or "", add_special_tokens=False).ids + [packing.END])
    found = packing.token_pieces(documents(spark), context=64).withColumn("crc", F.crc32("ids")).collect()
    for r in found:
        whole = ids[r.doc_id][0]
        assert r.doc_tokens == len(whole) and r.crc == packing.crc32_of(whole[r.start : r.start + r.length])
    assert Counter({i: sum(map(len, v)) for i, v in ids.items()}) == Counter({i: sum(r.length for r in found if r.doc_id == i) for i in ids})


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_words_encode_like_whole_texts(text):
    tok = packing.tokenizer(P.path(packing.VOCABULARY))
    got = packing.word_encoder(P.path(packing.VOCABULARY)).encode([text.encode("utf-8", "ignore").decode()])[0]
    assert list(memoryview(got).cast("I")) == tok.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|ENDOFTEXT|> b", "a <|endoftext|> B", "X<|startoftext|>Y. Z,", "H\u0331 J\u030c H\u0331.", "I\u0307 HA\u0331,", "ÉCOLE Über A, B.", "K\u05b0\u0331 \u0331K"])
def test_words_keep_the_case_that_counts(text):
    tok = packing.tokenizer(P.path(packing.VOCABULARY))
    encoder = packing.WordEncoder(P.path(packing.VOCABULARY))
    for t in (text.lower(), text, text.upper()):  # what is remembered of one does not leak into another
        assert list(memoryview(encoder.encode([t])[0]).cast("I")) == tok.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    path = P.path("byte_bpe_50k.json")
    texts = ["Two  words, <|endoftext|> HERE.", "", "a\n b"]
    got = packing.WordEncoder(path).encode(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == [packing.tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
@settings(max_examples=200, deadline=None)
def test_shortest_pack_first_places_everything(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for packs, items in patterns:
        assert packs > 0 and sum(n * k for n, k in items) <= 64
        for n, k in items:
            placed[n] += packs * k
    assert placed == Counter(histogram)
    tokens = sum(n * k for n, k in histogram.items())
    assert sum(packs for packs, _ in patterns) <= 2 * tokens / 64 + 1


def test_packing_places(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["word"] * draw.randint(0, 90))) for i in range(300)] + [(7, "again"), (None, None)]
    pieces = packing.token_pieces(documents(spark, rows), context=64)
    packed = packing.pack(pieces, 64)
    by = defaultdict(list)
    for r in packed.collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(n for v in by.values() for _, n in v)
    assert tokens == pieces.agg(F.sum("length")).first()[0] and tokens / (64 * len(by)) > 0.9
    built = packing.sequences(packed, 64).collect()
    assert len(built) == len(by) and sum(r.used for r in built) == tokens and all(len(r.tokens) == 64 for r in built)
    assert packing.packed_documents(documents(spark, [])).count() == 0


def test_positions_are_gapless(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(2).alias("k"), "id", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("spread"))
    got = defaultdict(list)
    for r in positions(df, ["k"], [F.col("spread"), F.col("id")], "at", rows_per_bin=10).collect():
        got[r.k].append(r["at"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def shard_rows(spark, rows, **how):
    return sharding.kd_shards(documents(spark, rows), **how).collect()


def test_kd_shards_balance_and_keep_copies(spark):
    draw = random.Random(2)
    rows = [(i, "word " * draw.randint(1, 60) + str(draw.random())) for i in range(900)]
    rows += [(1000 + i, rows[i % 40][1]) for i in range(80)]
    got = shard_rows(spark, rows, shards=8)
    size, slots, where = Counter(), defaultdict(list), defaultdict(set)
    text = dict(rows)
    for r in got:
        assert r.size == len(text[r.doc_id]) + 1
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(abs(v - mean) for v in size.values()) < 0.06 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in where.values())


def test_kd_shards_split_a_group_that_is_too_heavy(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(1200)]
    size = Counter()
    for r in shard_rows(spark, rows, shards=4):
        size[r.shard] += r.size
    mean = sum(size.values()) / 4
    assert max(abs(v - mean) for v in size.values()) < 0.06 * mean


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a"), (1, "a"), (None, "b")], TEXTS])
def test_kd_shards_awkward(spark, rows):
    got = shard_rows(spark, rows, shards=5)
    assert len(got) == len(rows) and all(0 <= r.shard < 5 for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def brute_shards(rows, shards):
    """rows: (key, size, dims, text hash, id hash); the k-d tree by sorting whole nodes, without slack."""
    span = [max(1, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in range(3)]
    out = {}

    def split(node, k, first):
        if k == 1 or not node:
            out.update({r[0]: first for r in node})
            return
        width = [(max(r[2][d] for r in node) - min(r[2][d] for r in node)) / span[d] for d in range(3)]
        d = width.index(max(width))
        at = lambda r: (r[2][d], r[3], r[4])
        want, before, left = sum(r[1] for r in node) * ((k + 1) // 2) / k, 0, set()
        for place in sorted({at(r) for r in node}):
            weight = sum(r[1] for r in node if at(r) == place)
            if before + weight >= want:
                if want - before > weight / 2:
                    left.add(place)
                break
            before += weight
            left.add(place)
        split([r for r in node if at(r) in left], (k + 1) // 2, first)
        split([r for r in node if at(r) not in left], k // 2, first + (k + 1) // 2)

    split(rows, shards, 0)
    return out


@pytest.mark.parametrize("shards,sums", [(2, 1 << 20), (5, 1 << 20), (8, 64)])
def test_kd_shards_are_those_of_a_plain_tree(spark, monkeypatch, shards, sums):
    for name, value in (("SLACK", 0), ("GROUP_SLACK", 0), ("SUMS", sums)):
        monkeypatch.setattr(sharding, name, value)
    draw = random.Random(shards)
    texts = ["é" * draw.randint(0, 9) + "w" * draw.randint(1, 40) + "\n" * draw.randint(0, 6) for _ in range(90)]
    rows = [(i, draw.choice(texts) if i % 3 else f"text {i} " * draw.randint(1, 9)) for i in range(160)]
    df = documents(spark, rows)
    hashes = {r.doc_id: (r.t, r.i) for r in df.select("doc_id", sharding._hash40(F.col("text")).alias("t"), sharding._hash40(F.col("doc_id"), F.lit("row")).alias("i")).collect()}
    sized = lambda t: len(t.encode())
    want = brute_shards([(i, sized(t) + 1, (len(t), t.count("\n"), sized(t) - len(t)), *hashes[i]) for i, t in rows], shards)
    assert {r.doc_id: r.shard for r in sharding.kd_shards(df, shards=shards).collect()} == want


def test_kd_shards_by_target(spark):
    got = shard_rows(spark, [(i, "x" * 99) for i in range(100)], target_bytes=1_700)
    assert len({r.shard for r in got}) == 6


def brute_topk(vectors, k):
    """Rows are told apart by their place; products and components stay within 64 bits."""
    lo, hi = -(2**63), 2**63 - 1
    clip = lambda x: max(lo, min(hi, x))
    ok = [(i, [clip(math.floor(1024 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % 5 == 0:
            scored = sorted((-clip(sum(x * y for x, y in zip(a, b, strict=False))), i) for m, (i, b) in enumerate(ok) if m != n)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("n,k,query_bytes", [(0, 3, 1 << 20), (1, 3, 1 << 20), (4, 10, 1 << 20), (300, 7, 1 << 20), (300, 3, 500)])
def test_topk(spark, monkeypatch, n, k, query_bytes):
    monkeypatch.setattr(topk, "HELD_BYTES", 3 * 8 * 6 * 8)  # three blocks at a time
    draw = random.Random(n)
    vectors = [(i, [draw.choice([-1.0, -0.25, 0.0, 0.3, 1.0]) + draw.choice([0.0, 0.001]) for _ in range(6)]) for i in range(n)]
    if n > 100:
        vectors += [(n + 1, None), (n + 2, [1.0, None, 1.0]), (n + 3, [float("nan")] * 6), (n + 4, [float("inf")] * 6), (None, [1.0] * 6), (n + 5, [0.5, 0.5]), (n + 6, [])]
        vectors += [(n + 10 + i, [0.3] * 6) for i in range(80)] + [(0, vectors[0][1]), (3, [1.0] * 6), (5, [-1.0] * 6)]
    draw.shuffle(vectors)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, score int, grp string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k, block_rows=8, query_bytes=query_bytes).collect())
    # components are floats, and so are the brute-force ones
    exact = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in vectors]
    assert got == brute_topk(exact, k)


@pytest.mark.parametrize("most", [1e9, 1e13, 1e15, 1e300])
def test_topk_of_components_of_any_size(spark, most):
    draw = random.Random(9)
    some = lambda: draw.choice([-1, 1]) * 10 ** draw.uniform(-3, math.log10(most))
    vectors = [(i, [some() if draw.random() < 0.3 else draw.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, [most, 0.0, 0.0, 0.0]), (65, [most, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 4, block_rows=8).collect()) == brute_topk(vectors, 4)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(4)
    q, m = draw.integers(-(2**62), 2**62, (3, 4)), draw.integers(-(2**62), 2**62, (9, 4))
    best = np.array([[max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in m)] for a in q], float)
    assert (topk.bounds(q, m.max(0)[None], m.min(0)[None]) >= best).all()
    centres = draw.integers(-1000, 1000, (40, 8))  # every block near a centre of its own: most are never scored
    blocks = [(m.max(0), m.min(0), np.arange(32) + 32 * b, np.arange(32) + 32 * b, m) for b, c in enumerate(centres) for m in [c + draw.integers(-5, 6, (32, 8))]]
    search = topk.Search(np.array([-1, -2]), np.stack([centres[0], centres[7]]), 10)
    for at in range(0, 40, 16):
        some = blocks[at : at + 16]
        search.take(some, [np.zeros(0, int)] * len(some))
    assert search.scored < 0.5 * search.met and not search.none.any()


def test_topk_sends_scores_of_the_best_blocks(spark):
    """Near centres by block, a query's first blocks of the whole table leave next to nothing to other tasks; results are all the same."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(100, 16))
    vectors = [(i, [float(x) for x in np.float32(centres[i // 16] + 0.05 * draw.normal(size=16))]) for i in range(1_600)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    visits = tuple(spark.sparkContext.accumulator(0) for _ in range(2))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, 10, block_rows=16, visits=visits).collect())
    assert got == brute_topk(vectors, 10)
    assert visits[1].value >= 320 * 100 and visits[0].value < 0.05 * visits[1].value


def test_topk_of_no_query(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(df, F.col("vec_id") == 2).collect() == []


def test_large_products_stay_exact():
    a = np.array([[2**40, -(2**39)]], np.int64)
    assert topk.dot(a, a)[0, 0] == 2**63 - 1
    assert topk.dot(np.array([[2**30, 3]]), np.array([[2**30, 5]]))[0, 0] == 2**60 + 15


def test_digest_helpers():
    assert packing.crc32_of([1, 2]) == __import__("zlib").crc32(bytes([1, 0, 0, 0, 2, 0, 0, 0]))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("doc_id", [None, 7])
def test_kd_shards_balance_rows_that_agree_in_all(spark, doc_id):
    rows = [(doc_id, "one text that stands in many rows")] * 800 + [(100 + i, f"text number {i:06d} of a plain kind") for i in range(100)]
    size, slots = Counter(), defaultdict(list)
    for r in shard_rows(spark, rows, shards=8):
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 8
    assert sorted(size) == list(range(8)) and max(abs(v - mean) for v in size.values()) < 0.02 * mean
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_pieces_of_null_ids_spread_over_bins(spark, monkeypatch):
    seen, plain = {}, packing.positions
    monkeypatch.setattr(packing, "positions", lambda df, keys, order, out: seen.setdefault("df", plain(seen.setdefault("in", df), keys, order, out, rows_per_bin=10)))
    packed = packing.pack(packing.token_pieces(documents(spark, [(None, "one two")] * 600), context=64), 64)
    assert packed.count() == 600
    bins = Counter(r.spread % 60 for r in seen["in"].collect())
    assert max(bins.values()) <= 30


def plain_packs(lengths, context):
    """Shortest-pack-first, a piece at a time: the longest first, each into the shortest pack that it fits."""
    packs = []
    for n in sorted(lengths, reverse=True):
        open_ = [p for p in packs if sum(p) + n <= context]
        (min(open_, key=sum) if open_ else packs.append([]) or packs[-1]).append(n)
    return packs


@given(st.lists(st.integers(34, 100), max_size=60))
@settings(max_examples=150, deadline=None)
def test_patterns_fill_packs_like_plain_packing_where_two_pieces_fit_at_most(lengths):
    found = Counter()
    for packs, items in packing.shortest_pack_first(Counter(lengths), 100):
        found[sum(n * k for n, k in items)] += packs
    assert found == Counter(map(sum, plain_packs(lengths, 100)))


@given(st.lists(st.integers(1, 64), min_size=1, max_size=80))
@settings(max_examples=150, deadline=None)
def test_patterns_take_about_as_many_packs_as_plain_packing(lengths):
    packs = sum(n for n, _ in packing.shortest_pack_first(Counter(lengths), 64))
    plain = len(plain_packs(lengths, 64))
    assert packs <= 1.25 * plain + 1
