import math

import pytest
from pyspark.sql import functions as F

from lodegraph.functions.scalars import case_style, erfc, glob_regex
from lodegraph.operators import history as H
from lodegraph.operators import scores as S
from lodegraph.operators import series as TS


def series(spark, xs):
    return spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(xs)], "series string, idx long, value double")


def test_series_anchors(spark):
    d = series(spark, [10, 11, 10, 12, 11, 10, 30, 11])
    z = {r["idx"]: (r["z"], r["anomaly"]) for r in TS.modified_z(d).collect()}
    assert z[6] == (pytest.approx(12.8155), 1) and sum(a for _, a in z.values()) == 1
    t = TS.theil_sen(d).first()
    assert t["slope"] == pytest.approx(0.171429, abs=1e-6) and t["direction"] == "increasing"
    m = TS.mann_kendall(d).first()
    assert (m["s"], round(m["z"], 4), round(m["p"], 5)) == (8, 0.9191, 0.35802)


def test_z_edge_cases(spark):
    assert TS.modified_z(series(spark, [1, 2, 3])).count() == 0
    assert [r["z"] for r in TS.modified_z(series(spark, [5] * 6)).collect()] == [0.0] * 6
    flagged = [r["idx"] for r in TS.modified_z(series(spark, [5, 5, 5, 5, 5, 99])).collect() if r["anomaly"]]
    assert flagged == [5]


def test_cusum_signals_and_resets(spark):
    xs = [0, 1, 0, 1, 0, 1, 0, 1, 9, 9, 9, 0, 1, 0]
    hits = TS.cusum(series(spark, xs)).collect()
    assert [(r["idx"], r["side"]) for r in hits] == [(8, 1), (9, 1), (10, 1)]


def test_western_electric(spark):
    hits = {(r["idx"], r["rule"]) for r in TS.western_electric(series(spark, [1, 2, 3, 4, 5, 6, 7, 40])).collect()}
    assert (7, 1) in hits and (5, 5) in hits


def test_erfc(spark):
    xs = [0.0, 0.1, 0.5, 1.0, 2.0, 3.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-6)


@pytest.fixture(scope="module")
def log(spark):
    sets = {1: "AB", 2: "AB", 3: "ABC", 4: "AC", 5: "D"}
    ids = {"A": 1, "B": 2, "C": 3, "D": 4}
    return spark.createDataFrame([(c, ids[f], 1, 0) for c, fs in sets.items() for f in fs], "commit_id long, file_id long, lines_added long, lines_removed long")


def test_cochange(log):
    p = H.cochange_pairs(log)
    assert {tuple(r) for r in p.collect()} == {(1, 2, 3), (1, 3, 2), (2, 3, 1)}
    c = {(r["file_id_a"], r["file_id_b"]): r for r in H.coupling(p, H.commit_counts(log), 5).collect()}
    assert (round(c[1, 2]["npmi"], 4), c[1, 2]["lift"], round(c[1, 2]["strength"], 4)) == (0.4368, 1.25, 0.8571)
    assert (round(c[2, 3]["npmi"], 4), round(c[2, 3]["lift"], 4), round(c[2, 3]["strength"], 4)) == (-0.1133, 0.8333, 0.4)
    assert {r["file_id"]: round(r["entropy"], 4) for r in H.cochange_entropy(p).collect()} == {1: 0.9434, 2: 0.6781, 3: 0.8480}


def test_dark_matter_and_surprise(spark, log):
    p = H.coupling(H.cochange_pairs(log), H.commit_counts(log), 5)
    none, tied = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(2, 1)], "src long, dst long")
    assert H.dark_matter(p, none).count() == 1 and H.dark_matter(p, tied).count() == 0
    cs = lambda *xs: spark.createDataFrame([(x,) for x in xs], "file_id long")
    assert H.surprise(log, cs(1, 2)).first()[0] == 0.0
    assert H.surprise(log, cs(8, 9)).first()[0] == 0.5
    assert H.surprise(log, cs(8)).first()[0] == 0.0


def test_percentiles_and_gini(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert S.index_percentile(d, "v", 0.75).first()[0] == 4
    assert d.select(F.percentile("v", F.lit(0.75))).first()[0] == 3.25
    assert {r["v"]: r["r"] for r in d.withColumn("r", S.strict_rank("v")).collect()}[3.0] == 0.5
    assert S.gini(d, "v").first()[0] == pytest.approx(0.25)


def test_health_bounds(spark):
    one = lambda *xs: spark.range(1).select(S.health(*map(F.lit, xs))).first()[0]
    assert one(0.0, 0.0, 0.0, 0.0, 10.0) == 100
    assert one(100.0, 50.0, 50.0, 50.0, 1.0) < 5


def test_names_and_globs(spark):
    names = ["a_b", "aB", "AbC", "A_B", "a-b", "x"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(case_style(F.col("n"))).collect()]
    assert got == ["snake", "camel", "pascal", "UPPER", "kebab", "lower"]
    import re

    assert re.match(glob_regex("src/**/x_*.py"), "src/a/b/x_1.py") and re.match(glob_regex("src/**/x_*.py"), "src/x_1.py")
    assert re.match(glob_regex("src/*.py"), "src/a/b.py") and not re.match(glob_regex("**/lib/*.py"), "x/lib/a/b.py")


def test_fn_coupling_all_keeps_every_pair(spark, tmp_path):
    from lodegraph.plans import catalog, registry

    assert catalog
    part = [(k, "a b", 4, "T", "B") for k in range(10, 50)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_size int, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    touched = {1: (10, 20), 2: (11, 21), 3: (12, 22), 4: (30, 40), 5: (31, 41)}  # files 1 and 2 three times, 3 and 4 twice
    li = [(c, f, 1.0, 0.0, "R" if c == 1 else "N", 0.01, f"2020-01-{f}" if f < 32 else "2020-01-31", "O") for c, fs in touched.items() for f in fs]
    spark.createDataFrame(li, "l_orderkey long, l_partkey long, l_quantity double, l_tax double, l_returnflag string, l_discount double, l_shipdate string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.QUERIES["fn_coupling_all"](spark, str(tmp_path)).select("a", "b", "cochange_count").collect()}
    assert got == {(a, b, 3) for a in range(10, 20) for b in range(20, 30)} - {(10, 20, 3)}


def test_pairs_take_tasks_by_input(spark):
    """Partitions were put together by compressed bytes, so a task's memory grew with the input."""
    from lodegraph.functions.lineage import tasks_for
    from lodegraph.operators import history as H

    assert tasks_for(spark.range(1_000_000)) == 7 and tasks_for(spark.createDataFrame([(1,)], "id long")) == 2
    changes = spark.range(400_000).selectExpr("id div 4 AS commit_id", "id % 4 AS file_id")
    pairs = H.cochange_pairs(changes)
    assert pairs.rdd.getNumPartitions() >= 4
    assert {tuple(r) for r in pairs.collect()} == {(a, b, 100_000) for a in range(4) for b in range(a + 1, 4)}


def test_fn_coupling_holds_tied_pairs_of_near_files_only(spark):
    from lodegraph.operators import history as H

    changes = spark.createDataFrame([(c, f) for c in range(3) for f in (1, 2, 3)] + [(9, 1), (9, 4)], "commit_id long, file_id long")
    symbols = spark.createDataFrame([(10 * f + k, f) for f in range(1, 5) for k in range(3)], "id long, file_id long")
    edges = spark.createDataFrame([(20, 11), (11, 20), (12, 42), (10, 12)], "src long, dst long")
    got = {tuple(r) for r in H.fn_coupling(changes, symbols, edges).collect()}
    assert got == {(10 * f + a, 10 * g + b, 3) for f, g in ((1, 2), (1, 3), (2, 3)) for a in range(3) for b in range(3)} - {(11, 20, 3)}
