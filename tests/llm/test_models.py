import random
import re

import numpy as np
from pyspark.sql import functions as F

from clinprep.llm import labelled, quality, toxicity, urls

from .helpers import TEXTS, documents

WORDS = "and the of to in for with that was his river garden market winter music paper window morning".split()
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300, seed=1):
    draw, rows, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, bad = draw.random() < 0.3, draw.random() < 0.3
        sentences = [" ".join(draw.choice(WORDS) for _ in range(8)) for _ in range(draw.randint(3, 9))]
        if toxic:
            sentences[draw.randrange(len(sentences))] += " you vile wretch" if i % 2 else " vilest wretches"
        lines = [". ".join(sentences[k : k + 2]) + "." for k in range(0, len(sentences), 2)]
        if bad:
            lines = ["$$$ ### " * draw.randint(2, 6) + "BUY!!" for _ in lines]
            toxic = False
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_held_out_folds(spark):
    from zlib import crc32

    got = {r.id: r.h for r in spark.range(50).select("id", labelled.held_out(F.col("id"), 3, 1).alias("h")).collect()}
    assert got == {i: crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_sample_is_bounded_and_stable(spark):
    rows, labels = corpus(60)
    ldf = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1), (3_000, None, None)], LABELS)
    runs = [labelled.training_texts(documents(spark, rows, p), ldf.repartition(p), "toxic", F.lit(True), per_class=8) for p in (1, 5)]
    assert runs[0][0] == runs[1][0] and sorted(runs[0][1]) == [0] * 8 + [1] * 8


def test_sample_of_long_and_repeated_texts(spark):
    rows = [(i, f"text {i}") for i in range(6)] + [(1, "another text of 1")] * 40 + [(7, "x" * (labelled.TEXT_BYTES + 1))]
    ldf = spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(2, 1, 1)], LABELS)
    texts, y = labelled.training_texts(documents(spark, rows), ldf, "toxic", F.lit(True))
    assert sorted(zip(texts, y.tolist(), strict=True)) == sorted([("another text of 1", 1), *[(f"text {i}", i % 2) for i in (0, 2, 3, 4, 5)]])


def test_toxicity_held_out_and_located(spark):
    rows, labels = corpus()
    df, ldf = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(df, ldf, ~labelled.held_out(F.col("doc_id"), 3, 1))
    truth = {i: t for i, _, t in labels}
    got = toxicity.toxicity(df.select("doc_id", "text"), model).collect()
    held = [r for r in got if __import__("zlib").crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.95
    for r in got:
        for s in r.offending if r.score >= 0.7 and truth[r.doc_id] else ():
            assert "vile" in r.text[s.start : s.end]


def test_noisy_or_is_one_minus_the_product():
    model = toxicity.NoisyOr({"bad": 3.0, "wors*": 1.0}, -2.0)
    text = "so bad. worse words! fine"
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -1.0 if "worse"[:4] == "wors" else -2.0, -2.0)]
    assert np.isclose(model.score([text])[0][0], 1 - np.prod([1 - x for x in p]))


def test_models_take_awkward_texts(spark):
    rows, labels = corpus(80)
    df, ldf = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    odd = documents(spark)
    tox = toxicity.toxicity(odd, toxicity.train(df, ldf, F.lit(True)))
    assert tox.count() == len(TEXTS) and tox.filter("score is null or not score between 0 and 1").count() == 0
    assert {r.score for r in tox.filter("text is null or text = ''").collect()} == {0.0}
    good = quality.quality(odd, quality.train(df, ldf, F.lit(True)))
    assert good.filter("score is null or not score between 0 and 1 or size(lines) <> size(split(coalesce(text, ''), '\\n', -1))").count() == 0
    for empty in (toxicity.train(df, ldf.limit(0), F.lit(True)).score([""])[0], quality.train(df, ldf.limit(0), F.lit(True)).score(["", "x"])[0]):
        assert all(0 <= x <= 1 for x in empty)
    assert quality.quality(documents(spark, []), quality.fit([], np.zeros(0, int))).count() == 0


def test_quality_held_out(spark):
    rows, labels = corpus()
    df, ldf = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    model = quality.train(df, ldf, ~labelled.held_out(F.col("doc_id"), 4, 2))
    truth = {i: q for i, q, _ in labels}
    held = quality.quality(df, model).filter(labelled.held_out(F.col("doc_id"), 4, 2)).collect()
    assert len(held) > 40 and np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in held]) > 0.97


def test_forward_backward_against_all_paths():
    draw = np.random.default_rng(2)
    counts = np.array([3, 1, 4])
    emission, transition = draw.normal(size=(8, 2)), draw.normal(size=(2, 2))
    got, pairs = quality.forward_backward(emission, counts, transition)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        weight, marginal, seen = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2**n):
            path = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(emission[at + k, y] for k, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            weight += w
            for k, y in enumerate(path):
                marginal[k, y] += w
            for a, b in zip(path, path[1:]):
                seen[a, b] += w
        assert np.allclose(got[at : at + n], marginal / weight)
        want_pairs += seen / weight
        at += n
    assert np.allclose(pairs, want_pairs)


URLS = [
    (0, "https://Blog.Example.ORG/es/12"), (1, "http://example.org/en/123"), (2, "http://example.org/en/2"), (3, "http://a.b.com/fr/x?y=/de/"), (4, "http://b.com/de/"),
    (5, "http://notexample.org/es/"), (6, None), (7, "no scheme"), (8, "http://x.net/fr/"), (9, "http://org"), (10, "http://example.com#/fr/"), (11, "x://y://z.com/fr/"),
    (12, "http://line\nbreak.com/fr/\nq"), (13, ""), (13, ""), (14, "http://EXAMPLE.ORG/ES/"),
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for what, rule in urls.RULES:
        own, start = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(start) and (best is None or len(rule) > len(best[1])):
            best = (what, rule)
    return host, path, best and best[1], best and best[0]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in URLS], "page_id long, url string, host string, rule string")
    model = urls.train(urls.rule_labels(df))
    for r in urls.filter_urls(df, model).collect():
        host, path, rule, verdict = brute_url(dict(URLS)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))
    assert urls.filter_urls(df.limit(0), urls.train(urls.rule_labels(df.limit(0)))).count() == 0


def test_url_model_held_out():
    draw = random.Random(4)
    make = lambda bad: urls.url_text(draw.choice(["casino", "winbig"] if bad else ["news", "school"]) + str(draw.randint(1, 99)) + ".example.com", f"/p/{draw.randint(1, 999)}")
    labels = np.array([draw.random() < 0.4 for _ in range(600)], int)
    data = [make(y) for y in labels]
    model = urls.fit(data[:400], labels[:400])
    assert np.mean((model.score(data[400:]) >= 0.5) == labels[400:]) > 0.98


def test_grams_stay_inside_their_url():
    a, b = "^abc d$", "^ü$"
    ids, of = urls.gram_ids([a, b, ""])
    alone, _ = urls.gram_ids([b])
    assert sorted(ids[of == 1]) == sorted(alone) and len(ids[of == 0]) == sum(len(a) - n + 1 for n in urls.GRAMS)


def test_quality_of_mixed_documents():
    """A text of good and bad lines is told line by line, and scores between its halves."""
    rows, labels = corpus(200, seed=5)
    texts, y = [t for _, t in rows], np.array([q for _, q, _ in labels])
    model = quality.fit(texts, y)
    good, bad = next(t for t, q in zip(texts, y, strict=True) if q), next(t for t, q in zip(texts, y, strict=True) if not q)
    scores, lines = model.score([good, good + "\n" + bad, bad])
    n = good.count("\n") + 1
    assert min(lines[1][:n]) > 0.5 > max(lines[1][n:])
    assert scores[0] > 0.7 and scores[0] >= scores[1] >= scores[2] and scores[2] < 0.5


def test_offending_sentences_lie_in_the_original_text():
    model = toxicity.NoisyOr({"vile": 6.0}, -3.0)
    text = "İİ İstanbul. You vile İ one! Fine. So vile"
    _, where = model.score([text, text.replace("İ", "I"), "", "fine"])
    assert [text[s["start"] : s["end"]] for s in where[0]] == [" You vile İ one", " So vile"]
    assert [(s["start"], s["end"]) for s in where[0]] == [(s["start"], s["end"]) for s in where[1]]
    assert where[2:] == [[], []]


def test_agreement_without_a_rule(spark):
    """A rule whose sites look like another rule's is foreseen; one that decides nothing gives zeros."""
    rules = (("block", "casino.example.com/"), ("block", "casino.example.net/"), ("allow", "school.example.com/"), ("allow", "never.example.org/"))
    pages = [(i, f"http://{'casino' if i % 2 else 'school'}.example.{'net' if i % 4 == 1 else 'com'}/{i}") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r: urls.agreement_without_rule(df, r, rules=rules).first() for r in ("casino.example.net/", "never.example.org/")}
    assert got["casino.example.net/"].n == 50 and got["casino.example.net/"].agree >= 48
    assert tuple(got["never.example.org/"]) == ("never.example.org/", 0, 0)
