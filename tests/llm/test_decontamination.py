import random
import re

import numpy as np
import pytest

from clinprep.llm import decontamination

from .helpers import TEXTS, documents

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), span)
        for p in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    ids |= windows[key]
        ids = sorted(str(x) for x in ids - {None})
        out.append((i, len(w), len(hit), len(ids), ids))
    return sorted(out, key=repr)


def benchmark(spark, items):
    """Items with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, t, 1, "w", "c") for i, t in items], "item_id long, text string, row_id long, words string, context string").repartition(2)


def found(out):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "item_ids")) for r in out.collect()), key=repr)


def prose(g, n, vocabulary=40):
    return " ".join(g.choice(["The", "of", "naïve", "x1", "東京", "end."]) if g.random() < 0.2 else f"w{g.randrange(vocabulary)}" for _ in range(n))


def test_planted_passages_are_found(spark):
    g = random.Random(7)
    items = [(n, prose(g, g.randint(1, 60))) for n in range(30)] + [(30, None), (31, ""), (32, "..."), (None, prose(g, 20))]
    docs = []
    for n in range(120):
        parts = [prose(g, g.randint(0, 80))]
        for _ in range(g.randint(0, 3)):
            w = (g.choice(items)[1] or "").split()
            lo = g.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[lo : lo + g.randint(1, 40)]).upper() if g.random() < 0.2 else "\n".join(w[lo:]), prose(g, g.randint(0, 12))]
        docs.append((n, " ".join(parts)))
    out, _ = decontamination.decontaminate(documents(spark, docs), benchmark(spark, items))
    want = brute(docs, items)
    assert found(out) == want and sum(r[2] > 0 for r in want) > 40


def test_few_words_repeat_without_end(spark):
    items = [(1, "a " * 40), (2, "a b " * 12), (3, "b"), (4, "a a a a a a a a"), (5, "a b a b a b a b a"), (6, "c a b a b a b a b a b a")]
    docs = [(1, "a " * 5000), (2, "a b " * 300), (3, "c " * 50), (4, "a a a"), (5, "x a b a b a b a b a b"), (6, "b"), (7, "a b a b a b a b a"), (8, "a a a a a a a a b b")]
    out, _ = decontamination.decontaminate(documents(spark, docs), benchmark(spark, items))
    assert found(out) == brute(docs, items)


@pytest.mark.parametrize("size", [1 << 26, 0])
def test_shared_windows_and_awkward_rows(spark, monkeypatch, size):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", size)  # a broadcast join and a shuffled one
    line = "Hello World, this is a shared line of text short hello world"
    items = [(1, line), (2, line.upper()), (2, "another line that only one document holds " * 2), (3, "the quick brown fox jumps over the lazy dog and runs away"), (4, "東京")]
    out, spans = decontamination.decontaminate(documents(spark), benchmark(spark, items))
    assert found(out) == brute(TEXTS, items)
    assert {r["item_id"] for r in spans.collect()} == {"1", "2", "3", "4"}


@pytest.mark.parametrize("docs, items", [([], [(1, "one two")]), ([(1, "one two three")], []), ([], []), ([(1, None), (None, "one")], [(1, None), (2, " - ")])])
def test_empty_sides(spark, docs, items):
    out, spans = decontamination.decontaminate(documents(spark, docs), benchmark(spark, items))
    assert found(out) == brute(docs, items) and spans.count() == 0


def test_word_hashes_do_not_depend_on_their_place(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 64)
    texts = [t.encode() for t in ("", "Ab ab", "--", "q" * 500 + " ab 7é", "ab")]
    found = decontamination.Words(texts)
    plain = [w for t in texts for w in words(t.decode())]
    assert found.count.tolist() == [len(words(t.decode())) for t in texts]
    assert len({(w, h) for w, h in zip(plain, found.hash.tolist(), strict=True)}) == len(set(plain)) == len(set(found.hash.tolist()))


def test_every_window_keeps_a_gram():
    g = np.random.default_rng(3)
    for _ in range(30):
        w = decontamination.Words([" ".join(f"w{x}" for x in g.integers(0, g.integers(1, 30), g.integers(0, 60))).encode() for _ in range(3)])
        at, _ = w.kept(8, 3)
        for first, n in zip(w.first, w.count, strict=True):
            for p in range(first, first + n - 9):
                assert ((at >= p) & (at + 8 <= p + 10)).any()
