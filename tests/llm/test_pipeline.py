import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from clinprep.llm import exact, jaccard, packing, quality, simhash, toxicity

from .helpers import documents
from .test_dedup import brute_exact
from .test_models import LABELS, corpus


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(8)
    rows, labels = corpus(160, seed=8)
    text = dict(rows)
    good = [i for i, q, t in labels if q and not t]
    rows += [(1000 + n, text[i].replace(" ", "  ")) for n, i in enumerate(good[:12])]  # equal texts
    for n, i in enumerate(good[20:32]):  # one word of a long text changed
        long = text[i] + " " + " ".join(draw.choice("abcdefgh") + str(k) for k in range(200))
        rows += [(2000 + n, long), (3000 + n, long.replace(" a", " z", 1))]
    rows += [(None, "an orphan text that has no id"), (5000, None), (5001, "")]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), labels


def near_links(rows):
    """Index pairs with a Jaccard similarity of 0.8 or more, and those of them that meet in a band and are in the ring."""
    known = [jaccard.shingles((t or "").encode(), pipeline.NEAR_WORDS) for _, t in rows]

    def sets(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    index, own, similar = {}, [sets(t) for _, t in rows], []
    for a, x in enumerate(own):
        for b in set().union(*(index.setdefault(g, []) for g in x)):
            if 5 * len(x & own[b]) >= 4 * len(x | own[b]):
                similar.append((a, b))
        for g in x:
            index[g].append(a)
    met = [jaccard.bands(h) for h, _ in known]
    bits = lambda a, b: sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(known[a][1], known[b][1], strict=True))
    return similar, [(a, b) for a, b in similar if bits(a, b) <= jaccard.RING.bits and any(x == y for x, y in zip(met[a], met[b], strict=True))]


def brute_near(rows):
    """The smallest id that each id reaches by such links; rows of one id are one document."""
    up = {i: i for i, _ in rows}
    links = [(rows[a][0], rows[b][0]) for a, b in near_links(rows)[1]]
    for _ in up:
        before = dict(up)
        for i, j in links:
            up[i] = up[j] = min(up[i], up[j])
        if up == before:
            break
    return up


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_follow_their_brute_force_versions(spark, tables):
    folder, text, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    everything = spark.read.parquet(f"{folder}/labels.parquet")
    steps = dict(pipeline.STAGES)
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]

    kept = steps["quality"](spark, docs, folder)
    assert kept.columns == docs.columns
    score = quality.train(docs, everything, F.lit(True)).score([t or "" for t in text.values()])[0]
    want = {i for i, s in zip(text, score, strict=True) if s >= pipeline.REJECT_QUALITY}
    assert set(texts_of(kept)) == want
    truth = {i: (q, t) for i, q, t in labels}
    assert np.mean([i in want for i, (q, _) in truth.items() if q]) > 0.98
    assert np.mean([i in want for i, (q, _) in truth.items() if not q]) < 0.02

    clean = steps["toxicity"](spark, kept, folder)
    model, left = toxicity.train(docs, everything, F.lit(True)), texts_of(kept)
    want = {i for i, s in zip(left, model.score([t or "" for t in left.values()])[0], strict=True) if s < pipeline.REJECT_TOXICITY}
    assert clean.columns == docs.columns and set(texts_of(clean)) == want
    assert np.mean([i in want for i, (q, t) in truth.items() if q and not t]) > 0.95
    assert np.mean([i in want for i, (q, t) in truth.items() if q and t]) < 0.1

    single = steps["exact_dedup"](spark, clean, folder)
    left = texts_of(clean)
    assert set(texts_of(single)) == {r[0] for r in brute_exact(list(left.items())) if r[3]}

    apart = steps["near_dedup"](spark, single, folder)
    left = texts_of(single)
    up = brute_near([(i, t) for i, t in left.items() if i is not None])
    assert apart.columns == docs.columns and set(texts_of(apart)) == {i for i in left if i is None or up[i] == i}
    assert not {2000 + n for n in range(12)} & set(texts_of(apart)) or not {3000 + n for n in range(12)} & set(texts_of(apart))

    packed = steps["packing"](spark, apart, folder).collect()
    left = texts_of(apart)
    sizes = {i: len(packing.tokenizer(__import__("public_tokenizers").path(packing.VOCABULARY)).encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes


def test_run_is_the_stages_one_after_another(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    columns = sorted(docs.columns)
    want = sorted(map(repr, docs.select(*columns).drop("sequence_id", "offset").collect()))
    assert sorted(map(repr, pipeline.run(spark, folder).select(*columns).drop("sequence_id", "offset").collect())) == want


def test_near_dedup_decides_by_jaccard_similarity(spark):
    draw = random.Random(3)
    word = lambda: f"w{draw.randrange(10**6)}"
    common, rows = [word() for _ in range(60)], []
    for n in range(150):
        one = [word() for _ in range(draw.choice((5, 9, 40, 200)))]
        one = one + common if n % 3 == 0 else one
        rows.append((n, " ".join(one)))
        for k in range(3):  # from hardly any to a third of the words changed
            other = list(one)
            for at in draw.sample(range(len(one)), int(len(one) * draw.choice((0.01, 0.02, 0.025, 0.03, 0.05, 0.3)))):
                other[at] = word()
            rows.append((1000 * (k + 1) + n, " ".join(other + [word() for _ in range(draw.choice((0, 0, 1, 9)))])))
    rows += [(9000, None), (9001, " "), (None, rows[0][1]), (9002, rows[5][1]), (9002, "two texts of one id here")]

    up = brute_near([r for r in rows if r[0] is not None])
    apart = pipeline.drop_near_copies(spark, documents(spark, rows), "")
    want = sorted((i for i, _ in rows if i is None or up[i] == i), key=repr)
    assert 100 < len(want) < len(rows) - 100
    assert sorted((r.doc_id for r in apart.select("doc_id").collect()), key=repr) == want
    similar, within = near_links([r for r in rows if r[0] is not None])
    assert len(within) > 0.99 * len(similar) > 100


def test_near_dedup_recall_on_documents(spark):
    """Of the pairs with a similarity of 0.8 or more, bands and ring must reach nearly all; no other pair is linked."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in exact.drop_exact_copies(docs, weight=F.length).select("doc_id", "text").collect()]
    similar, within = near_links(rows)
    assert similar and len(within) >= 0.99 * len(similar)
    found = {r.doc_id: r.component_id for r in jaccard.near_copies(docs.filter(F.col("doc_id").isin([i for i, _ in rows]))).collect()}
    up = brute_near(rows)
    assert {i: found.get(i, i) for i in up} == up


@pytest.mark.parametrize("size", [1, 2, 90])
def test_near_dedup_of_one_group_in_dealt_out_buckets(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "HOT_HOMES", 16)
    draw = random.Random(size)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = []
    for n in range(size):
        one = list(base)
        one[draw.randrange(300)] = f"x{n}"
        rows.append((n, " ".join(one)))
    rows += [(500 + n, " ".join(f"y{draw.randrange(10**6)}" for _ in range(200))) for n in range(60)]
    apart = pipeline.drop_near_copies(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in apart.select("doc_id").collect()) == [0, *range(500, 560)]


def test_pipeline_of_empty_tables_and_one_class(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, folder).count() == 0
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows, labels = corpus(30, seed=3)
    rows = rows + rows[:5] + [rows[0]] * 3  # repeated rows, and labels of one class only
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _, _ in labels], LABELS).write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r.n for r in pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert set(got) <= {i for i, _ in rows} and len(got) >= 0.5 * len(set(dict(rows).values()))


def test_sketches_never_overstate_what_is_unshared():
    draw = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (0, 1, 0), (1, 1, 1), (15, 5, 75), (400, 300, 10), (7_000, 6_000, 59_000)]:
        h = np.unique(draw.integers(0, 1 << 63, n + m + both, dtype=np.uint64))
        x, y = h[: both + n], np.r_[h[:both], h[both + n :]]
        a, b = (np.array(jaccard.sketch(z)).view(np.uint64) for z in (x, y))
        assert int(np.bitwise_count(a ^ b).sum()) <= n + m
        assert jaccard.unshared(jaccard.parity(x), jaccard.parity(y)) <= n + m


def test_few_pairs_leave_the_buckets_of_copies_that_are_not_near_one_another(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    rows = []
    for n in range(100):
        one = list(base)
        for k, at in enumerate(draw.sample(range(5, 145), 3)):
            one[at] = f"x{n}y{k}"
        rows.append((n, " ".join(one)))
    made, plain = {}, jaccard.store
    monkeypatch.setattr(jaccard, "store", lambda df, tag: made.setdefault(tag, plain(df, tag)) if tag == "candidates" else plain(df, tag))
    found = {r.doc_id: r.component_id for r in jaccard.near_copies(documents(spark, rows)).collect()}
    similar, reached = near_links(rows)
    assert all(found.get(rows[i][0]) == found.get(rows[j][0]) is not None for i, j in reached)
    assert made["candidates"].count() <= 2 * len(similar) + len(rows)
