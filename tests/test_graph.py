import random

import pytest

from lodegraph.operators import graph as G

# a..g = 1..7; a->b b->c c->a c->d d->e f->d e->g
EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 4), (5, 7)]


@pytest.fixture(scope="module")
def g(spark):
    return spark.createDataFrame([(i,) for i in range(1, 8)], "id long"), spark.createDataFrame(EDGES, "src long, dst long")


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_scc_and_layers(g):
    v, e = g
    assert rows(G.scc(v, e), "id", "scc") == {(1, 3), (2, 3), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)}
    layers = G.layers(v, e)
    assert rows(layers, "id", "layer") == {(1, 0), (2, 0), (3, 0), (6, 0), (4, 1), (5, 2), (7, 3)}
    assert G.violations(e, layers).count() == 0


def test_closure_and_cost(g):
    v, e = g
    c = G.closure(e)
    assert c.count() == 24
    assert c.agg(G.propagation_cost(c, 7)).first()[0] == pytest.approx(24 / 42)


def test_pagerank(g):
    v, e = g
    got = dict(rows(G.pagerank(v, e, damping=0.877, tolerance=1e-9), "id", "rank"))
    want = {1: 0.116399, 2: 0.144396, 3: 0.168950, 4: 0.153508, 5: 0.176941, 6: 0.042314, 7: 0.197492}
    assert got == pytest.approx(want, abs=2e-6)


def test_betweenness(g):
    v, e = g
    assert dict(rows(G.betweenness(v, e), "id", "betweenness")) == {1: 1, 2: 4, 3: 7, 4: 8, 5: 5, 6: 0, 7: 0}
    with pytest.raises(ValueError):
        G.betweenness(v, e, edge_limit=3)


def test_modularity_conductance_fiedler(spark, g):
    v, e = g
    labels = spark.createDataFrame([(i, 0 if i <= 3 else 1) for i in range(1, 8)], "id long, cluster long")
    assert G.modularity(e, labels).first()[0] == pytest.approx(0.3571, abs=1e-4)
    assert {(r["cut"], r["volume"]) for r in G.conductance(e, labels).collect()} == {(1, 7)}
    assert G.fiedler(e) == pytest.approx(0.321720, abs=1e-6)


def test_effects_extinction_paths(spark, g):
    v, e = g
    got = rows(G.effects(e, spark.createDataFrame([(7, "network")], "id long, effect string")), "id", "source")
    assert got == {(7, "direct"), *((i, "transitive") for i in range(1, 7))}
    dead = rows(G.extinction(e, spark.createDataFrame([(7,)], "id long")), "id", "round")
    assert {(7, 0), (5, 1), (4, 2), (6, 3)} <= dead
    kinds = spark.createDataFrame([(a, b, "call") for a, b in EDGES], "src long, dst long, kind string")
    assert [r["path"] for r in G.paths(kinds, 1, 7, most=6).collect()] == [[1, 2, 3, 4, 5, 7]]


def test_louvain_finds_the_two_groups(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    edges = clique(range(5)) + clique(range(10, 15)) + [(0, 10)]
    v = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15)]], "id long")
    e = spark.createDataFrame(edges, "src long, dst long")
    labels = G.louvain(v, e)
    assert G.modularity(e, labels).first()[0] > 0.4


def test_random_graphs_against_brute_force(spark):
    rng = random.Random(3)
    n = 14
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(24)) if a != b})
    reach = {(a, b) for a, b in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            break
        reach |= more
    v, e = spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long")
    assert rows(G.closure(e), "src", "dst") == reach
    scc = {i: max([i, *(j for j in range(n) if (i, j) in reach and (j, i) in reach)]) for i in range(n)}
    assert dict(rows(G.scc(v, e), "id", "scc")) == scc
    und = reach | {(b, a) for a, b in reach}
    comp = {i: i for i in range(n)}
    for _ in range(n):
        for a, b in und:
            comp[a] = min(comp[a], comp[b])
    assert dict(rows(G.components(v, e), "id", "component")) == comp


def test_empty_graph(spark):
    v, e = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "src long, dst long")
    assert rows(G.scc(v, e), "id", "scc") == {(1, 1), (2, 2)}
    assert rows(G.layers(v, e), "id", "layer") == {(1, 0), (2, 0)}
    assert G.fiedler(e) == 0.0
    assert G.closure(e).count() == 0


def test_fiedler_in_spark_equals_the_dense_laplacian(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(29)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(25)] + [(90, 91), (91, 92)]
    e = spark.createDataFrame(edges, "src long, dst long")
    assert G.fiedler(e, limit=3) == pytest.approx(G.fiedler(e), abs=1e-6) and G.fiedler(e) > 0
    star = spark.createDataFrame([(0, k) for k in range(1, 9)], "src long, dst long")
    assert G.fiedler(star, limit=3) == pytest.approx(1.0, abs=1e-6)


def test_scc_of_long_rings(spark):
    """One ring of 1,500 nodes, and the distributed way on a shorter ring with a tail."""
    ring = lambda n, at=0: [(at + k, at + (k + 1) % n) for k in range(n)]
    v = spark.range(1500).select("id")
    assert rows(G.scc(v, spark.createDataFrame(ring(1500), "src long, dst long")), "scc") == {(1499,)}
    e = spark.createDataFrame(ring(9) + ring(4, 20) + [(3, 20), (21, 30)], "src long, dst long")
    got = dict(rows(G.scc(spark.createDataFrame([(k,) for k in [*range(9), *range(20, 24), 30]], "id long"), e, in_one=0), "id", "scc"))
    assert got == {**{k: 8 for k in range(9)}, **{k: 23 for k in range(20, 24)}, 30: 30}


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "src long, dst long")
    got = dict(rows(G.components(spark.createDataFrame([(k,) for k in [*range(41), 100, 101, 200]], "id long"), e), "id", "component"))
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_rounds_do_not_grow_with_depth(spark):
    """A path of 120 nodes: closure, layers and communities took a round of Spark jobs a step."""
    e = spark.createDataFrame([(k, k + 1) for k in range(119)], "src long, dst long")
    v = spark.range(120).select("id")
    got, n = _jobs(spark, "closure", lambda: G.closure(e).count())
    assert got == 119 * 120 // 2 and n < 20
    got, n = _jobs(spark, "layers", lambda: rows(G.layers(v, e), "id", "layer"))
    assert got == {(k, k) for k in range(120)} and n < 20
    got, n = _jobs(spark, "louvain", lambda: G.modularity(e, G.louvain(v, e)).first()[0])
    assert got > 0.8 and n < 40


def test_pieces_equal_the_whole(spark, monkeypatch):
    """Components dealt to bins, one of them too large for a task, give what one task gives."""
    rng = random.Random(4)
    e = [(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(20)) if a != b]
    e += [(20, 21), (21, 22), (22, 20), (22, 23), (30, 31), (31, 31), (40, 41), (41, 40)]
    v, e = spark.range(45).select("id"), spark.createDataFrame(sorted(set(e)), "src long, dst long")
    run = lambda: [rows(G.closure(e, at), "src", "dst") for at in (G.IN_ONE_TASK, 5)] + [rows(G.layered(v, e, at), "id", "scc", "layer") for at in (G.IN_ONE_TASK, 5)]
    whole, labels = run(), rows(G.louvain(v, e), "id", "cluster")
    assert whole[0] == whole[1] and whole[2] == whole[3]
    monkeypatch.setattr(G, "A_TASK", 3)
    assert run() == whole and rows(G.louvain(v, e), "id", "cluster") == labels
    assert G.modularity(e, G.louvain(v, e, 5)).first()[0] > 0.9 * G.modularity(e, G.louvain(v, e)).first()[0]
