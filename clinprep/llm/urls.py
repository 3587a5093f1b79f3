"""URL filters: rules decide where one fits, a logistic regression on hashed character n-grams elsewhere.

Host and path are cut out by built-in functions and rules are column expressions. The model is trained on a small
labelled table of URLs, of at most SAMPLE rows; in the registered query those are URLs that the rules
decide. Its weights have a fixed size; scoring hashes all n-grams of a batch of URLs with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.text import ascii_lower, table

#: (verdict, rule) as given: host, then path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Labelled URLs that the model is fitted on, at most: those whose URLs hash lowest.
SAMPLE = 4_000
BITS = 16
GRAMS = (3, 4, 5)
THRESHOLD = 0.5


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        cut = text.index("/")
        own, start = text[:cut], text[cut:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def gram_ids(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the characters of all texts end to end, and the text of each."""
    sizes = np.fromiter(map(len, urls), np.int64, len(urls))
    data = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    of = np.repeat(np.arange(len(urls)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # characters from here to the text's end
    ids, owner = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ data[at + k]) * np.uint64(0x100000001B3)  # FNV-1a
        ids.append(((h ^ (h >> np.uint64(29))) & np.uint64((1 << BITS) - 1)).astype(np.int64))
        owner.append(of[at])
    return np.concatenate(ids), np.concatenate(owner)


def url_text(host: str, path: str) -> str:
    """What is cut into n-grams: host and path, with both ends marked."""
    return f"^{host} {path}$"


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, urls: list[str]) -> np.ndarray:
        ids, of = gram_ids(urls)
        n = np.maximum(1, np.bincount(of, minlength=len(urls)))
        z = self.bias + np.bincount(of, self.weights[ids], len(urls)) / np.sqrt(n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(urls: list[str], labels: np.ndarray, steps: int = 80) -> UrlModel:
    """Logistic regression with a small ridge, classes weighted alike; labels: 1 is to be blocked. No labels: 0.5 for all."""
    w, bias = np.zeros(1 << BITS), 0.0
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return UrlModel(w, 0.0 if not len(labels) else 4.0 if n1 else -4.0)
    ids, of = gram_ids(urls)
    share = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(urls))))
    weight = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(of, w[ids], len(urls)) * share, -40, 40)))
        d = (p - labels) * weight
        g = np.r_[np.bincount(ids, (d * share)[of], len(w)) + 1e-5 * w, d.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return UrlModel(w, bias)


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fit on (host, path, block) rows: at most ``sample`` distinct ones, the same whatever the partitions."""
    rows = labelled.select("host", "path", "block").filter("block is not null").distinct()
    found = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "block").limit(sample).collect()
    return fit([url_text(r["host"], r["path"]) for r in found], np.array([int(r["block"]) for r in found], np.int64))


def filter_urls(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score): a row for each input row.

    A null URL or one without :// has an empty host and path; no rule fits it and the model judges it. Repeated
    rows are judged alike. An empty table gives an empty result. Other columns are ignored.
    """
    cut = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    schema = T.StructType([*cut.schema.fields, T.StructField("block_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [url_text(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(urls))], [*batch.schema.names, "block_score"])

    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_score") >= THRESHOLD, "block").otherwise("allow")
    return cut.mapInArrow(run, schema).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "block_score")


def rule_labels(pages: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """(host, path, block) of the pages that a rule decides."""
    cut = pages.select(url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    verdict = rule_for(F.col("host"), F.col("path"), rules)[1]
    return cut.select("host", "path", (verdict == "block").alias("block"))


def agreement_without_rule(pages: DataFrame, rule: str, url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(rule, n, agree): the pages that ``rule`` decides, and those of them that a model trained on the other rules' pages judges alike.

    Says what the model knows of sites that no rule names. A rule that decides no page gives two zeros.
    """
    cut = pages.select(F.col(url_col).alias("url"), *[c.alias(n) for n, c in zip(("fits", "says"), rule_for(url_host(F.col(url_col)), url_path(F.col(url_col)), rules), strict=True)])
    model = train(rule_labels(cut.filter(F.col("fits") != rule), rules=rules), sample)
    judged = filter_urls(cut.filter(F.col("fits") == rule), model, "says", "url", rules=())
    return judged.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict") == F.col("page_id"), 1)).alias("agree"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row of ``pages``; the model learns from what the rules decide.

    A null URL or one without :// has an empty host and path and is judged by the model; repeated rows are judged alike;
    an empty table gives no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, train(rule_labels(pages)))
