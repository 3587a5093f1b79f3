import numpy as np
import pytest
from pyspark.sql import functions as F

from clinprep.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, id string, score double, rank int, list int"


def vectors(spark, rows):
    """Rows with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, y, 1, "x", 0.5, 3, 4) for i, v, y in rows], SCHEMA).repartition(3)


def brute(rows, divisor=50, shifted=True):
    base = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        base.append((i, (y + 1) % 10 if shifted and i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    dims = max([len(v) for _, _, v in base], default=0)
    base = [(i, y, v + [0] * (dims - len(v))) for i, y, v in base]
    out = []
    for a, (i, y, v) in enumerate(base):
        if i % divisor:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z == y, b) for b, (j, z, w) in enumerate(base) if b != a]
        for s, j, _, _ in sorted(x for x in scored if x[2])[:5]:
            fit = sorted((t, n) for t, n, same, _ in scored if not same and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def anchors():
    return F.col("vec_id") % 50 == 0


def clustered(n, dims=24, seed=3):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, dims))
    return [(i, (centres[i % 6] + g.normal(size=dims) * 0.7).tolist(), int(g.integers(0, 10))) for i in range(n)]


def test_mined_negatives_equal_brute_force(spark):
    rows = clustered(700)
    assert rows_of(negatives.mine(vectors(spark, rows), anchors(), label=label())) == brute(rows)


def test_mining_in_batches_of_anchors(spark):
    rows = clustered(400, dims=5, seed=9)
    found = negatives.mine(vectors(spark, rows), anchors(), label=label(), anchor_bytes=3 * 5 * 8)
    assert rows_of(found) == brute(rows) != []


def test_mining_awkward_rows(spark):
    v = [1.0, 0.5, -0.25]
    rows = [(0, v, 1), (0, v, 1), (1, v, 1), (2, v, 1), (3, [0.7, 0.4, -0.1], 2), (4, [0.7, 0.4, -0.1], 2), (4, [0.7, 0.4, -0.1], 2), (5, v, 2)]
    rows += [(6, [0.6, 0.3], 3), (8, None, 1), (9, [1.0, None, 2.0], 1), (10, [float("nan"), 1.0, 1.0], 2), (11, [float("inf"), 1.0, 1.0], 2), (12, v, None), (None, v, 1), (50, [-1.0, -1.0, 0.0], 4), (13, [], 4), (100, [0.0, 0.0, 0.0], 4)]
    assert rows_of(negatives.mine(vectors(spark, rows), anchors())) == brute(rows, shifted=False) != []


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)], [(0, None, None)]])
def test_mining_of_next_to_nothing(spark, rows):
    out = negatives.mine(vectors(spark, rows), anchors())
    assert rows_of(out) == []
    assert dict(out.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_intervals_hold_every_score():
    g = np.random.default_rng(1)
    for dims, scale in ((3, 40), (64, 256), (100, 1000), (130, 1 << 30)):
        x = np.rint(g.normal(size=(200, dims)) * scale).astype(np.int64)
        x[:3] = 0
        turns = negatives.Rotations(dims)
        low, high = negatives.Questions(turns, x).intervals(turns.encode(x), slice(0, 200))
        true = (x.astype(object) @ x.T.astype(object)).astype(float)
        assert (low <= true).all() and (true <= high).all()
        # four codes leave an eighth of a vector, more or less
        norm = np.linalg.norm(x.astype(float), axis=1)
        assert dims < 64 or np.median((high - low)[3:, 3:] / (norm[3:, None] * norm[None, 3:])) < 0.5


def test_most_pairs_are_not_scored():
    g = np.random.default_rng(5)
    x = np.rint(g.normal(size=(3000, 64)) * 100).astype(np.int64)
    labels = g.integers(0, 10, 3000)
    turns = negatives.Rotations(64)
    mining = negatives.Mining(np.arange(0, 3000, 50), labels[::50], x[::50], 5)
    for at in range(0, 3000, 1000):
        some = np.arange(at, at + 1000)
        mining.take(some, some, labels[some], x[some], turns.encode(x[some]))
    assert mining.met == 60 * 3000 and mining.scored < 0.05 * mining.met


def test_shares_of_scores_are_exact_at_the_ends_of_64_bits():
    s = np.array([0, 1, -1, 99, -99, 101, 7, 2**63 - 1, -(2**63) + 1, 12345678901234567], np.int64)
    for percent in (50, 95):
        assert negatives.share_down(s, percent).tolist() == [x * percent // 100 for x in s.tolist()]
        assert negatives.share_up(s, percent).tolist() == [-(-x * percent // 100) for x in s.tolist()]
