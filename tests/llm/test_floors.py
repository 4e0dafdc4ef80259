import numpy as np
import pytest

from ledgerloom.llm import topk


def want(rows, k=5):
    """Each query row's ranks, by plain products."""
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j) for b, (j, w) in enumerate(good) if a != b and len(w) == len(v))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"query_bytes": 0, "q_rows": 7, "c_rows": 100}])
def test_mixed_lengths_and_repeated_ids(spark, how):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=(8, 2, 1)[i % 3])]) for i in range(600)]
    rows += [(50, rows[50][1]), (50, rows[53][1]), (7, rows[7][1]), (700, None), (750, [float("nan")]), (None, [1.0, 2.0]), (800, []), (850, [3.0] * 9), (900, [1e9] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, dims int").repartition(3)
    got = topk.top_k(spark, df, **how).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want(rows)


def test_bounds_leave_few_to_resolve():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(4000, 4)))
    block = topk.Block(np.arange(4000), np.arange(4000), x)
    q = np.floor(256 * rng.normal(size=(20, 4)))
    found = topk.best_of_block(q, block, 6, np.full(20, -np.inf))
    for i, (at, score, depth) in enumerate(found):
        exact = x @ q[i]
        assert set(np.argsort(-exact)[:6]) <= set(at.tolist()) and (score == exact[at]).all()
        assert len(at) < 400 and depth <= 0.5  # most lists are not read to their ends
