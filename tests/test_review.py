"""Operators that SQL can't say, or whose scale path the data doesn't reach."""

import random

from lodegraph.operators import graph as G
from lodegraph.operators import review as V


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_weakest_edge_of_two_joined_rings(spark):
    """Two rings joined by one edge each way. 9 shortest paths run over (0, 1) as over (0, 10), so the smaller edge is named;
    by degrees it is the joint."""
    e = [(0, 1), (1, 2), (2, 0), (10, 11), (11, 12), (12, 10), (0, 10), (10, 0)]
    edges = _frame(spark, e, "src long, dst long")
    labels = _frame(spark, [(k, 12) for k in (0, 1, 2, 10, 11, 12)] + [(50, 50)], "id long, scc long")
    for limit, want in ((500, (0, 1)), (3, (0, 10))):
        (row,) = V.weakest_edges(labels, edges, limit).collect()
        assert (row["src"], row["dst"]) == want


def _flow(edges, s, t):
    """Least cut by brute force over all sides."""
    nodes = sorted({v for e in edges for v in e} - {s, t})
    best = len(edges)
    for mask in range(1 << len(nodes)):
        side = {s} | {v for k, v in enumerate(nodes) if mask >> k & 1}
        best = min(best, sum((a in side) != (b in side) for a, b in edges))
    return best


def test_cuts_of_large_pairs_equal_those_of_small_ones(spark):
    rng = random.Random(8)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(22)) if a != b})
    e, labels = _frame(spark, edges, "src long, dst long"), _frame(spark, [(k, k % 2) for k in range(9)], "id long, cluster long")
    (one,), (two,) = G.min_cuts(e, labels).collect(), G.min_cuts(e, labels, most=0).collect()
    assert one == two
    deg = {v: sum(v in x for x in edges) for v in range(9)}
    ends = [min((v for v in range(9) if v % 2 == c), key=lambda v: (-deg[v], v)) for c in (0, 1)]
    assert one["cut"] == _flow(edges, *ends)


def test_louvain_contracts_until_nothing_moves(spark):
    """A ring of 8 cliques of 4: local moves and contraction find each clique whole."""
    e = [(4 * c + a, 4 * c + b) for c in range(8) for a in range(4) for b in range(a + 1, 4)] + [(4 * c, (4 * c + 5) % 32) for c in range(8)]
    v = spark.range(33).select("id")
    labels = G.louvain(v, _frame(spark, e, "src long, dst long"))
    got = {r["id"]: r["cluster"] for r in labels.collect()}
    assert len({got[4 * c + k] for c in range(8) for k in range(4)}) <= 8 and all(len({got[4 * c + k] for k in range(4)}) == 1 for c in range(8)) and got[32] == 32
    assert G.modularity(_frame(spark, e, "src long, dst long"), labels).first()[0] > 0.6


def test_empty_tables(spark):
    symbols = _frame(spark, [], "id long, file_id long, name string, qualified string, kind string, is_exported int")
    edges, files = _frame(spark, [], "src long, dst long, kind string"), _frame(spark, [], "id long, path string, dir string, is_test int")
    assert V.safe_delete(symbols, edges, files).count() == 0 and V.change_set(symbols, edges, files).count() == 0
    assert V.deepest_chain(symbols, edges).count() == 0 and V.match_packages(_frame(spark, [("x",)], "package string"), symbols, edges).count() == 0


def test_spans_of_a_frequent_name(spark):
    """Every symbol of a name was held against every file asked for: 3,000 of one name made 9,000,000 pairs."""
    files = _frame(spark, [(k, f"src/m{k % 7}/f{k}.py") for k in range(3000)], "id long, path string")
    symbols = _frame(spark, [(k, k, "run") for k in range(3000)] + [(9000, 5, "alone")], "id long, file_id long, name string")
    asked = [("run", f"/f{k}.py") for k in range(3000)] + [("run", "f.py"), ("run", ""), ("run", None), ("alone", "x.py"), ("gone", "f1.py"), ("run", "x" * 99)]
    d = V.match_spans(_frame(spark, asked, "name string, file string"), symbols, files)
    got = {(r["name"], r["file"]): (r["id"], r["how"]) for r in d.collect()}
    want = {("run", f"/f{k}.py"): (k, "path") for k in range(3000)}
    want |= {("run", x): (None, "none") for x in ("f.py", "", None, "x" * 99)} | {("alone", "x.py"): (9000, "name"), ("gone", "f1.py"): (None, "none")}
    assert got == want
    assert "endswith" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_best_match_sends_no_candidates_through_the_driver(spark):
    symbols = _frame(spark, [(1, 1, "run", "a.run", "function", 1), (2, 2, "run", "b.run", "function", 0)], "id long, file_id long, name string, qualified string, kind string, is_exported int")
    files = _frame(spark, [(1, "x/f.py", "x"), (2, "y/g.py", "y")], "id long, path string, dir string")
    refs = _frame(spark, [(7, "run", "call", "z/h.py", "z", "", None), (8, "run", "call", "y/g.py", "y", "b", None)], "ref long, name string, kind string, file string, dir string, parent string, import_dir string")
    d = V.best_match(refs, symbols, files)
    assert {tuple(r) for r in d.collect()} == {(7, 1, "exported"), (8, 2, "file")}
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
