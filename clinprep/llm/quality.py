"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its evidence comes from its own shape and from the shapes of the lines before and after
it; transitions tie neighbours together. The field is trained on documents whose lines all carry the document's
label. Forward-backward gives each line's probability of being good; their mean, weighted by length, is mapped to
the document's score by a logistic curve fitted on the same documents.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clinprep.llm.labelled import SAMPLE_PER_CLASS, held_out, score_texts, training_texts
from clinprep.llm.text import table

THRESHOLD = 0.7
LETTERS = bytes(b for b in range(256) if chr(b).isalpha() and b < 128 or b >= 128)
CAPITALS = bytes(range(65, 91))
DIGITS = b"0123456789"
SPACES = b" \t\r\x0b\x0c"
STOPS = b".,;:'\"()?-"


def line_shape(line: bytes) -> tuple[float, ...]:
    """Shares of letters, capitals, digits, stops and other signs; repetition; length of the words and of the line."""
    n = len(line) or 1
    letters = n - len(line.translate(None, LETTERS)) if line else 0
    capitals = n - len(line.translate(None, CAPITALS)) if line else 0
    digits = n - len(line.translate(None, DIGITS)) if line else 0
    spaces = n - len(line.translate(None, SPACES)) if line else 0
    stops = n - len(line.translate(None, STOPS)) if line else 0
    words = line.split()
    k = len(words) or 1
    again = sum(map(eq, words, words[1:]))
    return (letters / n, capitals / (letters or 1), digits / n, stops / n, max(0, len(line) - letters - digits - spaces - stops) / n, again / k, len(set(words)) / k, min(len(line) / k, 20) / 20, np.log1p(len(line)) / 10)


SHAPES = 9
#: One in so many pairs of a good and a bad training document also makes a chain of both.
MIXED = 4


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines end to end (own, before, after, 1), each line's weight, and the lines of each text."""
    split = [t.encode().split(b"\n") for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    own = np.array([line_shape(x) for lines in split for x in lines], float).reshape(-1, SHAPES)
    weight = np.fromiter((len(x) + 1 for lines in split for x in lines), float, len(own))
    first = np.zeros(len(own), bool)
    first[np.cumsum(counts)[:-1]] = True
    first[:1] = True
    before = np.r_[own[:1], own[:-1]] if len(own) else own
    before = np.where(first[:, None], own, before)
    last = np.r_[first[1:], True] if len(own) else first
    after = np.r_[own[1:], own[-1:]] if len(own) else own
    after = np.where(last[:, None], own, after)
    return np.c_[own, before, after, np.ones(len(own))], weight, counts


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def forward_backward(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each position's two labels, and the expected transitions of all chains together.

    emission: (positions, 2), chains end to end; all chains advance together, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than t
    alpha, beta = emission.copy(), np.zeros_like(emission)
    for t in range(1, steps):
        at = starts[: alive[t]] + t
        alpha[at] += _lse(alpha[at - 1][:, :, None] + transition, 1)
    for t in range(steps - 1, 0, -1):
        at = starts[: alive[t]] + t
        beta[at - 1] = _lse(transition + (emission[at] + beta[at])[:, None, :], 2)
    joint = alpha + beta
    total = _lse(joint, 1)
    marginal = np.exp(joint - total[:, None])
    inner = np.ones(len(emission), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1][:, :, None] + transition + (emission[at] + beta[at])[:, None, :] - total[at][:, None, None]).sum(0)
    return marginal, pairs


class LineField:
    def __init__(self, weights: np.ndarray, transition: np.ndarray, mean: np.ndarray, scale: np.ndarray, slope: float = 8.0, middle: float = 0.5):
        self.weights, self.transition, self.mean, self.scale, self.slope, self.middle = weights, transition, mean, scale, slope, middle

    def emission(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights
        return np.c_[-z / 2, z / 2]

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being good, weight, and lines of each text."""
        x, weight, counts = line_features(texts)
        return forward_backward(self.emission(x), counts, self.transition)[0][:, 1], weight, counts

    def share(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        good, weight, counts = self.lines(texts)
        of = np.repeat(np.arange(len(counts)), counts)
        share = np.bincount(of, good * weight, len(counts)) / np.bincount(of, weight, len(counts))
        return share, np.split(good, np.cumsum(counts)[:-1])

    def score(self, texts: list[str]) -> tuple[list[float], list[list[float]]]:
        if not texts:
            return [], []
        share, good = self.share(texts)
        return (1 / (1 + np.exp(-self.slope * (share - self.middle)))).tolist(), [g.tolist() for g in good]


def _mixed(texts: list[str], labels: np.ndarray) -> tuple[list[str], list[tuple[int, int]]]:
    """Chains of a good and a bad text, either first, for one in MIXED pairs; with the first's label and lines."""
    good, bad = (np.flatnonzero(labels == y)[::MIXED].tolist() for y in (1, 0))
    pairs = [(a, b) if n % 2 else (b, a) for n, (a, b) in enumerate(zip(good, bad, strict=False))]
    return [texts[a] + "\n" + texts[b] for a, b in pairs], [(int(labels[a]), texts[a].count("\n") + 1) for a, _ in pairs]


def fit(texts: list[str], labels: np.ndarray, steps: int = 120) -> LineField:
    """Gradient ascent on the likelihood of the line labels, then the logistic curve of the document score.

    Without documents of both classes every document gets a score on that class's side.
    """
    width = 3 * SHAPES + 1
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    if not n1 or not n0:
        return LineField(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width), 0.0 if not len(labels) else 1.0, -8.0 if n1 else 8.0)
    mixed, turns = _mixed(texts, labels)
    x, _, counts = line_features(texts + mixed)
    of = np.repeat(np.arange(len(counts)), counts)
    label = np.r_[labels, [y for y, _ in turns]].astype(np.int64)
    turn = np.r_[counts[: len(texts)], [n for _, n in turns]].astype(np.int64)  # lines before the label changes
    at = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
    y = np.where(at < turn[of], label[of], 1 - label[of])
    # each document counts alike, and so does each class
    per_line = (np.where(label > 0, 0.5 / n1, 0.5 / n0) / counts)[of]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    mean[-1], scale[-1] = 0, 1
    field = LineField(np.zeros(width), np.zeros((2, 2)), mean, scale)
    z = np.clip((x - mean) / scale, -6, 6)
    pairs_seen = np.zeros((2, 2))
    inner = np.flatnonzero(at > 0)
    np.add.at(pairs_seen, (y[inner - 1], y[inner]), 1)
    links = max(1, int((counts - 1).sum()))
    params, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for step in range(1, steps + 1):
        field.weights, field.transition = params[:width], params[width:].reshape(2, 2)
        marginal, pairs = forward_backward(field.emission(x), counts, field.transition)
        g = np.r_[z.T @ ((y - marginal[:, 1]) * per_line) - 1e-3 * field.weights, ((pairs_seen - pairs) / links).ravel() - 2e-2 * params[width:]]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.transition = params[:width], params[width:].reshape(2, 2)
    share, _ = field.share(texts)
    a, b = 4.0, -2.0
    balance = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    for _ in range(500):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        r, h = (labels - p) * balance, p * (1 - p) * balance
        g = np.array([(r * share).sum() - 1e-4 * a, r.sum() - 1e-4 * b])
        hess = np.array([[(h * share * share).sum() + 1e-4, (h * share).sum()], [(h * share).sum(), h.sum() + 1e-4]])
        d = np.linalg.solve(hess, g)
        d *= min(1.0, 2.0 / (np.abs(d).max() + 1e-9))
        a, b = a + d[0], b + d[1]
        if np.abs(d).max() < 1e-6:
            break
    a = max(a, 1e-3)
    field.slope, field.middle = float(a), float(-b / a)
    return field


def train(docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE_PER_CLASS, **cols) -> LineField:
    """Fit on ``labels.quality`` of the usable rows, per_class documents of each class at most; see labelled.SAMPLE_PER_CLASS."""
    return fit(*training_texts(docs, labels, "quality", usable, per_class=per_class, **cols))


def quality(docs: DataFrame, model: LineField, text_col: str = "text") -> DataFrame:
    r"""``docs`` with ``score`` (0 to 1) and ``lines``: the probability of each line (cut at \n) of being good.

    Columns of these names are replaced. A null or empty text is one empty line and scored like any other. Whole texts are read.
    Each row is scored by its text alone, so repeated rows get equal scores; an empty table gives an empty result.
    """
    return score_texts(docs, text_col, model.score, [T.StructField("score", T.DoubleType()), T.StructField("lines", T.ArrayType(T.DoubleType()))])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``.

    Labels of held-out ids are not read. Null, empty and repeated texts as in quality; a null id is never held out; without
    labels of both classes all scores are on the side of the one that is there, and 0.5 without any.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    out = quality(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
