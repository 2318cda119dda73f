"""Quality rules against the same estimator in numpy, the classifier's compiled column against its model, and held-out labels."""

import os
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import quality_classifier as C
from lodegraph.llm import quality_rules as Q
from lodegraph.llm.textstats import with_stats

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def _distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def by_numpy(x):
    """Squared distances under the minimum covariance determinant of integer vectors: three starts, steps until none helps."""
    ridge, best = np.diag([(1000 * f) ** 2 for f in Q.FLOOR]), (np.inf, None, None)
    at = lambda c, q: np.sort(c // 10)[int(np.ceil(q * len(c))) - 1] * 10 + 5
    middle = np.array([at(c, 0.5) for c in x.T], dtype=float)
    wide = np.diag([((at(c, 0.75) - at(c, 0.25)) / 1.349) ** 2 for c in x.T])
    for mean, cov in [(middle, wide + ridge), (middle, ridge), (x.mean(0), np.cov(x.T, bias=True) * Q.CONSISTENT + ridge)]:
        det = np.inf
        while True:
            bins = np.minimum(np.floor(np.log1p(_distances(x, mean, cov)) * 64), 4000)
            order = np.sort(bins)
            last = order[int(np.ceil(Q.SHARE * len(x))) - 1]
            core = x[bins <= last]
            m, c = core.mean(0), np.cov(core.T, bias=True) * Q.CONSISTENT
            low = np.zeros_like(c)  # the ridge enters as the factor is made
            for i in range(Q.P):
                for j in range(i + 1):
                    v = c[i, j] - low[i, :j] @ low[j, :j]
                    low[i, j] = np.sqrt(max(v, 0) + ridge[i, i]) if i == j else v / low[j, j]
            new = np.log(np.diag(low)).sum()
            if new >= det - 1e-9:
                break
            mean, cov, det = m, low @ low.T, new
        if det < best[0]:
            best = (det, mean, cov)
    return _distances(x, *best[1:])


def test_distances_equal_numpys(spark):
    rng = np.random.default_rng(3)
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_upper n_lines".split()
    rows = []
    for lang, n in (("en", 500), ("de", 300)):
        w = rng.integers(60, 400, n)
        rows += [(lang, "s", int(a), int(a * rng.normal(5, 0.3)), int(rng.integers(0, 9)), int(rng.integers(0, 3)), int(rng.integers(0, a // 5)), int(rng.integers(2, 30)), 10) for a in w]
        rows += [(lang, "s", 100, 900, 300, 0, 0, 400, 10)] * (n // 10)
    d = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{x} long" for x in names))
    got = Q.judged(d, *Q.fit(d)).select("lang", *[c.alias(f"x{i}") for i, c in enumerate(Q.vector())], "d2", "kept").toPandas()
    for lang in ("en", "de"):
        own = got[got["lang"] == lang]
        want = by_numpy(own[[f"x{i}" for i in range(Q.P)]].to_numpy(dtype=float))
        assert np.allclose(own["d2"], want, rtol=1e-6, atol=1e-6)
        assert ((own["d2"] <= Q.CUTOFF) == own["kept"]).all() and not own["kept"][own["x1"] > 500].any()


def test_small_groups_pool_and_tiny_ones_pass(spark):
    rows = [("en", f"s{k % 9}", 100, 500 + k % 7, 1, 0, 0, 9, 10) for k in range(90)] + [("fr", "s", 100, 500, 90, 0, 0, 9, 10)] * 5 + [("en", "s1", 100, 500, 400, 0, 0, 9, 10)]
    d = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long")
    got = Q.judged(d, *Q.fit(d)).collect()
    assert [r["kept"] for r in got if r["lang"] == "fr"] == [True] * 5 and all(r["d2"] is None for r in got if r["lang"] == "fr")
    assert all(r["kept"] == (r["n_symbols"] == 1) for r in got if r["lang"] == "en")


@needs_data
def test_held_out_labels_and_the_compiled_column(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = C.learn(docs, labels)
    cols = list(C.features())
    stats = with_stats(docs, "text", "s_").select("doc_id", *[c.alias(k) for k, c in C.features("s_").items()]).toPandas()
    want = dict(zip(stats["doc_id"], model.score(stats[cols].to_numpy(dtype=float)), strict=True))
    got = {r["doc_id"]: r["score"] for r in C.scored(docs, model).select("doc_id", "score").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    pairs = [(got[a] > got[b]) + 0.5 * (got[a] == got[b]) for a, x in marks.items() for b, y in marks.items() if x == 1 and y == 0]
    assert len(pairs) > 100 and np.mean(pairs) > 0.95
    assert np.mean([(got[k] >= C.THRESHOLD) == (v == 1) for k, v in marks.items()]) > 0.9


def test_fixed_names_of_the_callers_stay(spark):
    """Columns called like working columns come back as they were."""
    d = spark.createDataFrame([(k, "some words of a text " * 20, "en", "s", 1) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars int")
    d = d.withColumn("_c_good", F.lit("mine")).withColumn("_c_n_words", F.lit("mine")).withColumn("_q_kept", F.lit("mine")).withColumn("good", F.lit("mine"))
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    out = C.accepted(d, labels).toPandas()
    assert len(out) == 5 and (out[["_c_good", "_c_n_words", "_q_kept", "good"]] == "mine").all().all()
    assert Q.filtered(d).columns == d.columns


def test_long_texts_are_scored_whole(spark):
    d = spark.createDataFrame([(1, "word other " * 400_000 + "### $$$"), (2, "")], "doc_id long, text string")
    model = C.Model(list(C.features()), 0.0, [((2, True, 0.0),)], [3.0])
    got = {r["doc_id"]: r["score"] for r in C.scored(d, model).collect()}
    assert got[1] == pytest.approx(1 / (1 + np.exp(-3))) and got[2] == 0.5
    assert pd.notna(got[2])
