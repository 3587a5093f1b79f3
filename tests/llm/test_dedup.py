import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clinprep.llm import exact, graph, lines, simhash, text

from .helpers import TEXTS, documents, tuples

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), float("inf") if i is None else i, i))
    out, done = [], set()
    for i, t in rows:
        norm = SPACE.sub("", t or "")
        best = min(groups[norm], key=lambda g: g[:2])
        kept = (i, -len(t or "")) == (best[2], best[0]) and norm not in done
        if kept:
            done.add(norm)
        out.append((i, best[2], len(groups[norm]), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_groups(spark):
    assert tuples(exact.exact_groups(documents(spark), weight=F.length), *COLUMNS) == brute_exact(TEXTS)


def test_exact_bytes_decide_when_hashes_collide(spark):
    weak = lambda c: F.lit("same").cast("binary")
    assert tuples(exact.exact_groups(documents(spark), weight=F.length, digest=weak), *COLUMNS) == brute_exact(TEXTS)


def test_exact_smallest_id_without_weight(spark):
    rows = [(5, "a b"), (2, "ab"), (9, "a   b")]
    assert {r.keep_id for r in exact.exact_groups(documents(spark, rows)).collect()} == {2}


def test_exact_empty_and_kept_documents(spark):
    assert exact.exact_groups(documents(spark, [])).count() == 0
    kept = exact.drop_exact_copies(documents(spark), weight=F.length)
    assert kept.columns == documents(spark).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 1, 2, 5, 6, 7, 8, 10, 11, 12]


REPEATS = [(2, "a b"), (5, "ab"), (5, "other"), (7, "same"), (7, "same"), (None, "x y"), (None, "xy"), (None, None), (None, " "), (8, "xy z"), (8, "x yz")]


@pytest.mark.parametrize("digest", [None, lambda c: F.lit("same").cast("binary")])
def test_exact_keeps_one_row_of_repeated_and_null_ids(spark, digest):
    how = {"weight": F.length} | ({"digest": digest} if digest else {})
    got = exact.exact_groups(documents(spark, REPEATS), **how)
    assert tuples(got, *COLUMNS) == brute_exact(REPEATS)
    kept = tuples(exact.drop_exact_copies(documents(spark, REPEATS), **how), "doc_id", "text")
    assert [(i, SPACE.sub("", t or "")) for i, t in kept] == [(2, "ab"), (5, "other"), (7, "same"), (8, "xyz"), (None, ""), (None, "xy")]
    assert (None, "x y") in kept and (None, " ") in kept  # the longer originals


def test_exact_groups_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(text, "BROADCAST_BYTES", -1)
    assert tuples(exact.exact_groups(documents(spark), weight=F.length), *COLUMNS) == brute_exact(TEXTS)
    assert exact.drop_exact_copies(documents(spark), weight=F.length).count() == len({SPACE.sub("", t or "") for _, t in TEXTS})


def test_exact_hot_group(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}") for i in range(400)]
    got = exact.exact_groups(documents(spark, rows)).filter("kept").collect()
    assert len(got) == 201 and max(r.group_size for r in got) == 200


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            holders[k].append(-1 if i is None else i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if gone.get(key(x), i) == (-1 if i is None else i) or key(x) not in gone]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINE_COLUMNS = ("doc_id", "n_lines", "n_dropped", "kept_text")


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(spark, batches):
    assert tuples(lines.line_dedup(documents(spark), batches=batches), *LINE_COLUMNS) == brute_lines(TEXTS)


def test_line_dedup_random(spark):
    draw = random.Random(3)
    pool = [f"a line of some length number {i}" for i in range(12)] + ["short", "", "  "]
    rows = [(i, "\n".join(draw.choice(pool) for _ in range(draw.randint(0, 9)))) for i in range(60)]
    assert tuples(lines.line_dedup(documents(spark, rows)), *LINE_COLUMNS) == brute_lines(rows)


def test_line_dedup_of_too_many_ids_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    assert tuples(lines.line_dedup(documents(spark)), *LINE_COLUMNS) == brute_lines(TEXTS)


def test_line_dedup_empty(spark):
    assert lines.line_dedup(documents(spark, [])).count() == 0


def test_line_runs_compact(spark):
    runs = lines.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([x]), 10 - b) for x in range(b, b + 3)], "line binary, doc_id long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    got = {bytes(r.line): (r.n_docs, r.keeper) for r in runs.merged().collect()}
    assert got == {bytes([x]): (min(x + 1, 3, 7 - x), 10 - max(0, x - 2)) for x in range(7)}


def brute_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    up = {i: i for i, _ in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= bits:
                a_root, b_root = root(i), root(j)
                up[max(a_root, b_root)] = min(a_root, b_root)
    return {i: root(i) for i, _ in prints}


def test_simhash_texts(spark):
    rows = [r for r in dict.fromkeys(TEXTS) if r[0] is not None]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark)).collect()}
    prints = [(i, brute_print(t)) for i, t in rows]
    assert {i: got[i].f0 & (2**64 - 1) for i, _ in prints} == dict(prints)
    assert {i: got[i].component_id for i, _ in prints} == brute_components(prints, 4)
    assert got[None].component_id is None


@pytest.mark.parametrize("ring", [simhash.Ring(4), simhash.Ring(6, (16,) * 4, (0, 1, 2, 0)), simhash.Ring(7, (20, 22, 22), (3, 2, 0))])
def test_pigeonring_finds_every_link(spark, ring):
    draw = random.Random(5)
    prints = [(0, draw.getrandbits(64))]
    for i in range(1, 300):
        base = draw.choice(prints)[1] if draw.random() < 0.8 else draw.getrandbits(64)
        for b in draw.sample(range(64), draw.randint(0, 9)):
            base ^= 1 << b
        prints.append((i, base))
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in prints], "doc_id long, f0 long").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, ring).collect()}
    assert got == brute_components(prints, ring.bits)


def test_hot_bucket_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_HOMES", 16)
    draw = random.Random(6)
    base = draw.getrandbits(64)
    prints = [(i, base ^ draw.getrandbits(21) & draw.getrandbits(21)) for i in range(150)]
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in prints], "doc_id long, f0 long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, simhash.Ring(4)).collect()}
    assert got == brute_components(prints, 4)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_long_paths_and_stars(spark):
    draw = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 100)] + [(900, 900), (950, 940)]
    draw.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 500 for i in range(500, 600)}, 940: 940, 950: 940}


def brute_documents(rows, bits):
    """rows: (id, fingerprint); rows of one id are one document."""
    up = {i: i for i, _ in rows}
    links = [(i, j) for n, (i, a) in enumerate(rows) for j, b in rows[:n] if (a ^ b).bit_count() <= bits]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(up[i], up[j])
            changed |= low != up[i] or low != up[j]
            up[i] = up[j] = low
    return up


@pytest.mark.parametrize("more", [[], [(4, -1)]])
def test_rows_of_one_id_are_one_document(spark, more):
    big = (1 << 63) - 1
    rows = [(2, 3), (5, 1), (5, big), (9, big), (7, 0x0F0F << 20), (7, 0x0F0F << 40), (8, 0x0F0F << 40), (3, 0x0F0F << 20 | 1)] + [(i, big ^ 0x3FFFFF << 9) for i, _ in more]
    rows += [(5, big ^ 0x3FFFFF << 9)] if more else []
    df = spark.createDataFrame(rows + [(None, 3)], "doc_id long, f0 long").repartition(3)
    got = {(r.doc_id, r.component_id) for r in simhash.near_components(df, simhash.Ring(4)).collect()}
    want = brute_documents([(i, f & (2**64 - 1)) for i, f in rows], 4)
    assert got == {*want.items(), (None, None)}
    assert want[9] == 2
