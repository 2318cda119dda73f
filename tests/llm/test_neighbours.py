"""Nearest neighbours: recall at the shipped setting over several cells, and how many rows the stopping test leaves unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import neighbours as A


def _recall(spark, x, every=20, k=20):
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in A.nearest(d).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, len(x), every):
        s = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), -s))[: k + 1] if i != q][:k]
        mine = sorted(got[q])
        assert [n for n, *_ in mine] == list(range(1, k + 1)) and [v for *_, v in mine] == pytest.approx([s[i] for _, i, _ in mine], rel=1e-12)
        assert sorted(mine, key=lambda t: (-t[2], t[1])) == mine
        hit += len(set(best) & {i for _, i, _ in mine})
    return hit / (k * len(range(0, len(x), every)))


def _vectors(kind, n, dims=64):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dims))
    if kind != "gaussian":
        x = rng.standard_normal((n // 100, dims))[rng.integers(0, n // 100, n)] + 0.1 * x
    if kind == "norms":
        return x * np.exp(rng.standard_normal((n, 1)))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["gaussian", "clusters", "norms"])
def test_recall_over_several_cells(spark, kind):
    assert _recall(spark, _vectors(kind, 20_000)) >= 0.9  # three cells or more, CONFIDENCE as shipped


def test_stopping_test_leaves_most_rows_unread():
    x = _vectors("clusters", 50_000)
    norm2 = float((x * x).sum(1).max()) * (1 + 1e-12)
    q = x[::500]
    got, verified = A.search(x, A._projected(x, norm2), np.arange(len(x)), q, A._projected_query(q), norm2, 21, np.full(len(q), -np.inf), A.chi_square_point(A.CONFIDENCE, A.M_DIMS))
    assert verified < 0.2 * len(x) * len(q)
    hits = [len(set(rows) & set(np.argsort(-(x @ v))[:21])) for (rows, _), v in zip(got, q, strict=True)]
    assert sum(hits) >= 0.9 * 21 * len(q)


def test_doubles_ties_and_large_norms(spark):
    """Doubles aren't rounded, ties at large norms go to smaller ids, and vectors of other lengths never meet."""
    rows = [(0, [1e6 + 1e-4, 0.0]), (1, [1e6, 1.0]), (2, [1e6, 1.0]), (3, [1e6, 2.0]), (4, [0.0, -1e300]), (5, [1.0]), (6, [-0.0, -1e300])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in A.nearest(d, k=3, every=100).orderBy("rank").collect()]
    assert got == [(1, 1, (1e6 + 1e-4) * 1e6), (2, 2, (1e6 + 1e-4) * 1e6), (3, 3, (1e6 + 1e-4) * 1e6)]
    assert A.nearest(d.filter(F.lit(False))).count() == 0
