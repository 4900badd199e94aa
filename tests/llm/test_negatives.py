"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm.hard_negatives import RowIndex, hard_negatives

SCHEMA = "vec_id long, label long, weights array<long>, key string, rank string, qb string"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    known = sorted({(i, lab, tuple(w)) for i, lab, w in rows if i is not None and lab is not None and w is not None})
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, w in known:
        if not anchors(i):
            continue
        scored = [(dot(w, v), j, m) for j, m, v in known if j != i]
        best = sorted((-s, j) for s, j, m in scored if m == lab)[:positives]
        for p, pid in best:
            fits = sorted((-s, j) for s, j, m in scored if m != lab and low * -p <= 100 * s <= high * -p)[:negatives]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, anchors, **kw):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(5)
    return sorted(tuple(r) for r in hard_negatives(df, anchors, **kw).select(*COLS).collect())


@pytest.mark.parametrize("dims,spread,size", [(20, 40, 120), (3, 2, 90), (40, 300, 60)])
def test_negatives_equal_brute_force(spark, dims, spread, size):
    rng = np.random.default_rng(dims)
    rows = [(i, int(rng.integers(0, 3)), [int(x) for x in rng.integers(-spread // 3, spread, rng.integers(max(1, dims - 4), dims + 1))]) for i in range(size)]
    rows += [(None, 1, [1]), (1000, None, [1]), (1001, 1, None), (1002, 1, []), (1003, 0, [0] * dims), rows[3], rows[3]]     # nulls, empties, repeats
    rows += [(2000 + i, 1, rows[10][2]) for i in range(30)]                                                            # ties
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, rows_per_block=40, anchors_per_block=3)
    assert got == brute(rows, lambda i: i % 10 == 0)


def test_same_id_with_other_weights_is_a_row_of_its_own(spark):
    rows = [(0, 0, [3, 4]), (0, 1, [4, 4]), (1, 0, [5, 5]), (1, 0, [6, 1]), (2, 1, [3, 1]), (3, 1, [2, 2])]
    got = mined(spark, rows, F.col("vec_id") == 0)
    assert {r[:2] for r in got} <= {(0, 1), (0, 2), (0, 3)} and not any(r[3] == 0 for r in got)
    assert sorted(set(got)) == sorted(set(brute(rows, lambda i: i == 0)))


def test_weights_beyond_double_precision_are_exact(spark):
    big = 2**31
    rows = [(0, 0, [big, 1]), (1, 0, [big, 3]), (2, 0, [big, 2]), (3, 1, [big * 8 // 10, 7]), (4, 1, [big * 8 // 10, 8]), (5, 1, [big, 2]), (6, 1, [big * 9 // 10, 0])]
    assert mined(spark, rows, F.col("vec_id") == 0) == brute(rows, lambda i: i == 0)


def test_empty_and_lonely(spark):
    assert mined(spark, [], F.col("vec_id") == 0) == []
    assert mined(spark, [(0, 1, [1, 2])], F.col("vec_id") == 0) == []
    assert mined(spark, [(5, 1, [1, 2]), (6, 2, [1, 2])], F.col("vec_id") == 0) == []


def test_index_omits_and_prunes_but_loses_nothing():
    rng = np.random.default_rng(5)
    w = (rng.normal(size=(64, 3_000)) * np.linspace(60, 1, 64)[:, None]).astype(np.int64)
    index = RowIndex(w, 64)
    q = index.whole[:, :20].astype(np.float64)
    s = q.T @ index.x
    least = np.full(20, 0.6 * s.max())
    rows, scores = index.reaching(q, least)
    wanted = np.flatnonzero((s >= least[:, None]).any(axis=0))
    assert len(rows) < 1_000 and set(wanted) <= set(rows)
    assert np.array_equal(scores, s[:, rows])
