"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

A sentence is toxic with probability p = sigmoid(bias + weights of its words and word stems); a document is
toxic unless all its sentences are clean: 1 - prod(1 - p), the noisy-or. Weights are trained from document
labels alone, by gradient descent through the noisy-or; the sentence scores then locate what offends.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.labelled import SAMPLE_PER_CLASS, held_out, score_texts, training_texts
from clinprep.llm.text import table

FEATURES = 4_096
STEMS = (4, 5, 6, 7)
#: A feature counts if its presence in documents tells the classes apart by so many standard deviations.
TELLS = 5.0
THRESHOLD = 0.7
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
OFFENDING = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def features(sentence: str) -> set[str]:
    """The words of a lower-cased sentence, and the stems (with a star) of those longer than a stem."""
    words = set(WORD.findall(sentence))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def bag_of_sentences(text: str) -> list[set[str]]:
    """The features of every sentence with a word in it."""
    return [f for m in SENTENCE.finditer(text.lower()) if (f := features(m[0]))]


def in_original(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) of the lower-cased text as spans of the text itself, with all characters that they touch.

    A few capitals become two characters in lower case, so that what follows them lies further on there.
    """
    ends = list(accumulate(len(c.lower()) for c in text)) if spans else []
    if not ends or ends[-1] == len(text):
        return spans
    return [(bisect_right(ends, a), bisect_right(ends, b - 1) + 1) for a, b in spans]


class NoisyOr:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.roots = {f[: STEMS[0]] for f in weights if f.endswith("*")}

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence of the lower-cased text with a word in it."""
        weights, roots, out = self.weights, self.roots, []
        for m in SENTENCE.finditer(text.lower()):
            words = set(WORD.findall(m[0]))
            if words:
                found = [w for w in words if w in weights]
                stemmed = [w for w in words if w[: STEMS[0]] in roots]
                if stemmed:
                    found += {s for w in stemmed for k in STEMS if len(w) > k and (s := w[:k] + "*") in weights}
                z = self.bias + sum(weights[f] for f in sorted(found))
                out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))))
        return out

    def score(self, texts: list[str]) -> tuple[list[float], list[list[dict]]]:
        scores, where = [], []
        for text in texts:
            found = self.sentences(text)
            clean = 0.0
            for _, _, p in found:
                clean += math.log1p(-min(p, 1 - 1e-12))
            scores.append(-math.expm1(clean))
            bad = [(a, b, p) for a, b, p in found if p >= 0.5]
            spans = in_original(text, [(a, b) for a, b, _ in bad])
            where.append([{"start": a, "end": b, "score": p} for (a, b), (_, _, p) in zip(spans, bad, strict=True)])
        return scores, where


def fit(texts: list[str], labels: np.ndarray, n_features: int = FEATURES, steps: int = 150) -> NoisyOr:
    """Adam through the noisy-or, over the features that tell toxic documents from clean ones.

    Without documents of both classes the model is the bias alone, very low or very high.
    """
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return NoisyOr({}, 8.0 if n1 else -20.0)
    # texts are cut twice, so that the features of all sentences are never held at once
    seen = [Counter(), Counter()]
    for text, y in zip(texts, labels.tolist(), strict=True):
        seen[y].update(set().union(*bag_of_sentences(text)))
    least = 3 if n1 >= 20 else 1

    def tells(f: str) -> float:
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n1 + n0)
        return (a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)

    ranked = sorted(((d, f) for f in seen[1] if seen[0][f] + seen[1][f] >= least and (d := tells(f)) >= TELLS), reverse=True)[:n_features]
    seen.clear()
    vocabulary = {f: i for i, (_, f) in enumerate(ranked)}
    cols, sentence_of, bag_of, n = array("q"), array("q"), array("q"), 0
    for b, text in enumerate(texts):
        for s in bag_of_sentences(text):
            found = [vocabulary[f] for f in s if f in vocabulary]
            cols.extend(found)
            sentence_of.extend([n] * len(found))
            bag_of.append(b)
            n += 1
    cols, sentence_of, bag_of, y = np.array(cols, np.int64), np.array(sentence_of, np.int64), np.array(bag_of, np.int64), labels.astype(float)
    w = np.full(len(vocabulary), 2.0)
    bias, m, v = -7.0, np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    for step in range(1, steps + 1):
        z = np.clip(bias + np.bincount(sentence_of, w[cols], n), -40, 40)
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(bag_of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))
        bad = -np.expm1(clean)
        # d loss / d z: for a toxic bag -p (1 - bad) / bad, for a clean bag p
        dz = np.where(y[bag_of] > 0, -p * ((1 - bad) / np.maximum(bad, 1e-9))[bag_of], p) * weight[bag_of] / len(y)
        g = np.r_[np.bincount(cols, dz[sentence_of], len(w)) + 1e-4 * w, dz.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return NoisyOr({f: float(w[i]) for f, i in vocabulary.items() if abs(w[i]) > 0.02}, float(bias))


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE_PER_CLASS, **cols) -> NoisyOr:
    """Fit on ``labels.toxic`` of the usable rows, per_class documents of each class at most; see labelled.SAMPLE_PER_CLASS."""
    return fit(*training_texts(docs, labels, "toxic", usable, per_class=per_class, **cols))


def toxicity(docs: DataFrame, model: NoisyOr, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``offending``: (start, end, score) of sentences scored 0.5 or more.

    Columns of these names are replaced. A null or empty text, or one without words, has no sentence and scores 0.
    Whole texts are read; offsets count code points of the text. Each row is scored by its text alone, so
    repeated rows get equal scores; an empty table gives an empty result.
    """
    return score_texts(docs, text_col, model.score, [T.StructField("score", T.DoubleType()), T.StructField("offending", OFFENDING)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) of every row of ``documents``; offending locates its toxic sentences.

    Labels of held-out ids are not read. Null, empty and repeated texts as in toxicity; a null id is never held out; without
    labels of both classes every score is on the side of the one that is there, and near 0 without any.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(F.col("doc_id"), 3, 1))
    out = toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
