import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from racecard.llm import hard_negatives
from racecard.llm.hard_negatives import Vectors, bounds, exact, levels, mine, padded_size, summaries

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, vector string, summary string, slot string, n int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x", "x", 1) for row in rows], SCHEMA)


def brute(rows, every=10, low=80, high=100):
    """Every score, one by one."""
    fit = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows
           if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in fit:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in fit if j != i]
        for p, j, _ in sorted(x[:2] + (0,) for x in scored if x[2] == c)[:5]:
            near = sorted((s, k) for s, k, d in scored if d != c and low * -p <= 100 * -s <= high * -p)[:5]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(near, 1)]
    return sorted(out)


def mined(df, every=10, **options):
    found = mine(df, F.col("id") % every == 0, **options)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()))


def drawn(seed, n, size, clusters=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (clusters, size))
    return [(i, (centres[i % clusters] * 0.5 + draw.normal(0, 0.1, size)).astype(np.float32).tolist(),
             int(draw.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("size", [3, 24, 64])
def test_equals_brute_force(spark, size):
    rows = drawn(size, 400, size)
    assert mined(table(spark, rows).repartition(5)) == brute(rows)
    assert len(brute(rows)) > 100


def test_many_anchor_blocks(spark, monkeypatch):
    rows = drawn(1, 300, 16)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", 12_000)
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(hard_negatives, "PAIRS_AT_ONCE", 30)
    assert mined(table(spark, rows)) == brute(rows)


def test_ties_repeats_and_a_hot_vector(spark):
    """A third of the rows are one vector, some rows are repeated whole, some ids have two vectors."""
    rows = drawn(2, 90, 16)
    hot = rows[20][1]
    rows += [(100 + i, hot, i % 3) for i in range(50)] + [rows[10]] * 3 + [(10, rows[11][1], 1), (20, hot, 2)]
    assert mined(table(spark, rows).repartition(4)) == brute(rows)


def test_rows_that_take_no_part(spark):
    rows = drawn(3, 60, 8)
    odd = [(None, rows[0][1], 1), (70, None, 1), (80, rows[0][1], None), (90, [1.0] * 7 + [None], 0),
           (100, [float("nan")] * 8, 0), (110, [float("inf")] + [0.0] * 7, 0)]
    assert mined(table(spark, rows + odd)) == brute(rows)


def test_empty_short_and_large_vectors(spark):
    rows = [(0, [], 0), (1, [0.5], 0), (2, [1.0, 2.0], 0), (3, [1e30, 1.0], 1), (10, [3.0], 1), (11, [2.9, 1.0], 0)]
    assert mined(table(spark, [r for r in rows if r[0] != 3])) == brute([(i, v + [0.0] * (2 - len(v)), c) for i, v, c in rows if i != 3])
    mined(table(spark, rows))


def test_no_rows_no_anchors(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []


def test_negative_and_zero_positives(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [-0.9, 0.0], 1), (4, [0.0, 2.0], 1), (5, [-1.0, 3.0], 1)]
    assert mined(table(spark, rows)) == brute(rows)
    assert mined(table(spark, rows), low=50, high=150) == brute(rows, low=50, high=150)


def test_bounds_hold_and_narrow():
    draw = np.random.default_rng(4)
    whole = draw.integers(-300, 300, (50, padded_size(61)))
    own = Vectors(np.arange(50), np.zeros(50), whole, summaries(whole))
    true = whole @ whole.T
    spread = []
    for level in range(len(levels(whole.shape[1]))):
        lower, upper = bounds(own, own, level)
        assert (lower <= true).all() and (true <= upper).all()
        some = (np.array([0, 3, 7]), np.array([7, 3, 1]))
        few = bounds(own, own, level, some)
        assert np.allclose(few[0], lower[some]) and np.allclose(few[1], upper[some])
        spread.append((upper - lower).mean())
    assert spread == sorted(spread, reverse=True) and len(spread) > 2


def test_exact_beyond_doubles():
    big = np.array([[2 ** 30, 1], [2 ** 30 - 1, 3]])
    own = Vectors(np.arange(2), np.zeros(2), big, summaries(big))
    pairs = tuple(np.array(x) for x in zip(*itertools.product(range(2), range(2))))
    assert exact(own, own, pairs).tolist() == (big @ big.T).ravel().tolist()
