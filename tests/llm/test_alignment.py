import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from clinprep.llm import alignment

from .helpers import TEXTS, documents

ODD = [
    (20, "word  two   spaces \n\n next\tline  "),
    (21, " "),
    (22, "  "),
    (23, "▁ a literal mark▁ and more"),
    (24, "<|endoftext|> and </s> and <0x0A> and <unk> stay text <s>"),
    (25, "\x00 nul \x1c and \x85 next line 　 wide \xa0 joined"),
    (26, "ends with a space "),
    (27, "\n leads with a line and it's we'll they've 'quoted'"),
    (28, "é café ﬁ ① 한국어 текст العربية 👩‍👩‍👧‍👦 𝔘𝔫𝔦"),
    (29, "x" * 3000),
    (30, "a▁b"),
]


def letters():
    """The byte of each letter of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


def brute(rows):
    """Whole texts at once, one token at a time."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = letters()
    links, seen = [], Counter()
    for i, t in rows:
        spans = None
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            xs = [bytes(byte[c] for c in a.id_to_token(n)) for n in x]
            ys = [bytes([int(b.id_to_piece(n)[3:5], 16)]) if b.is_byte(n) else b.id_to_piece(n).replace("▁", " ").encode() for n in y]
            if b"".join(xs) == b"".join(ys) == (" " + t).encode():
                ends = [np.cumsum([len(z) for z in zs]).tolist() for zs in (xs, ys)]
                spans = [[(n, e - len(z), e) for n, z, e in zip(ids, zs, es)] for ids, zs, es in zip((x, y), (xs, ys), ends)]
        pairs = [(m, n) for m, s, e in spans[0] for n, u, v in spans[1] if u < e and s < v] if spans else []
        seen.update(pairs)
        links.append((i, spans, pairs))
    top = Counter()
    for (_, n), c in seen.items():
        top[n] = max(top[n], c)
    out = []
    for i, spans, pairs in links:
        if not spans:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(n) for n, s, v in side if lo <= s and v <= e) for side in spans))
            lo = e
        out.append((i, len(spans[0]), len(spans[1]), len(groups), len(pairs), sum(seen[p] == top[p[1]] for p in pairs), sum(seen[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_alignment_equals_whole_texts(spark):
    rows = [(i, t if t is None or len(t) < 4000 else t[:4000]) for i, t in TEXTS + ODD]
    assert found(alignment.align(documents(spark, rows))) == brute(rows)


def test_alignment_in_rounds(spark):
    rows = [(i, t) for i, t in TEXTS + ODD if t is None or len(t) < 1000]
    assert found(alignment.align(documents(spark, rows), round_bytes=64 * alignment.PAIR_BYTES)) == brute(rows)


def test_alignment_when_a_task_forgets(spark, monkeypatch):
    rows = [(i, t) for i, t in TEXTS + ODD if t is None or len(t) < 1000]
    for name, n in (("STRETCHES", 5), ("CHARS", 50), ("GATHERED", 3)):
        monkeypatch.setattr(alignment, name, n)  # in this process: the helpers below run here
    known = alignment.Stretches(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))
    for _, t in rows:
        at = known.numbered([t])[0]
        a, b = known.settled()[at].sum(0)[:2]
        assert (a == 0) == (not t or "▁" in t)
        if known.full():
            known.clear()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")], [(1, "▁")]])
def test_alignment_of_next_to_nothing(spark, rows):
    assert found(alignment.align(documents(spark, rows))) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]


def test_pairs_have_their_counts(spark):
    docs = documents(spark, [(1, "one two"), (2, "one two"), (3, "two")])
    counts = alignment.PairCounts(docs, "text", public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE), alignment.ROUND_BYTES)
    assert sorted(r.n for r in counts.table().collect()) == [2, 3]


def test_perfect_hash_is_minimal_and_tells_strangers():
    g = np.random.default_rng(2)
    keys = np.unique(g.integers(0, 1 << 32, 60_000, dtype=np.uint32))
    part, rows = alignment.part_of(keys), []
    for p in range(alignment.PARTS):
        sizes, bits, order = alignment.perfect_levels(keys[part == p])
        assert sorted(order.tolist()) == keys[part == p].tolist()
        rows.append({"part": p, "sizes": sizes, "bits": bits, "keys": order.astype(np.uint32).tobytes()})
    whole = alignment.PerfectHash(rows)
    assert sorted(whole.numbers(keys).tolist()) == list(range(len(keys)))
    assert (whole.keys[whole.numbers(keys)] == keys).all()
    others = np.setdiff1d(g.integers(0, 1 << 32, 10_000, dtype=np.uint32), keys)
    assert (whole.numbers(others) == -1).all()
    assert len(whole.bits) * 64 < 6 * len(keys) + 64 * 12 * alignment.PARTS
    assert alignment.PerfectHash([]).numbers(keys[:3]).tolist() == [-1, -1, -1]


def test_dense_vectors_sum_in_a_tree(spark):
    g = np.random.default_rng(4)
    legs = 3 * alignment.FAN + 5
    rows = [(s, leg, g.integers(0, 9, 4).tolist()) for s in range(3) for leg in range(legs)]
    df = spark.createDataFrame([(s, leg, bytearray(np.array(c, np.int64).tobytes())) for s, leg, c in rows], alignment.SUMS).repartition(5)
    out = {r["slice"]: np.frombuffer(bytes(r["counts"]), np.int64).tolist() for r in alignment.tree_sum(df).collect()}
    assert out == {s: np.sum([c for t, _, c in rows if t == s], axis=0).tolist() for s in range(3)}
