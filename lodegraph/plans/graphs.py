"""Graph queries on the driver's tables. Oracles are DuckDB recursive queries on the same sparse graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import graph as G
from ..operators import scores as S
from ..sources.adapters import Tables
from .code import put

V = ", v AS (SELECT id FROM symbols)"
CLO = V + ", clo AS (SELECT src, dst FROM graph UNION SELECT c.src, g.dst FROM clo c JOIN graph g ON g.src = c.dst)"
SCC = CLO + ", scc AS (SELECT v.id, coalesce(max(CASE WHEN b.src IS NOT NULL THEN a.dst END), v.id) AS raw FROM v LEFT JOIN clo a ON a.src = v.id LEFT JOIN clo b ON b.src = a.dst AND b.dst = a.src GROUP BY 1), sc AS (SELECT id, greatest(raw, id) AS scc FROM scc)"
LAY = SCC + (
    ", dag AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM graph g JOIN sc a ON a.id = g.src JOIN sc b ON b.id = g.dst WHERE a.scc <> b.scc), walk AS (SELECT DISTINCT scc AS id, 0 AS layer FROM sc UNION SELECT d.dst, w.layer + 1 FROM walk w JOIN dag d ON d.src = w.id), "
    "lay AS (SELECT sc.id, CAST(max(layer) AS BIGINT) AS layer FROM sc JOIN walk ON walk.id = sc.scc GROUP BY 1)"
)


def _bfs(seed: str, edges: str = "graph", a: str = "src", b: str = "dst", most: int = 50) -> str:
    return f", walk AS (SELECT id AS root, id AS node, 0 AS dist FROM ({seed}) UNION SELECT root, g.{b}, dist + 1 FROM walk JOIN {edges} g ON g.{a} = node WHERE dist < {most}), bf AS (SELECT root, node, CAST(min(dist) AS BIGINT) AS dist FROM walk GROUP BY 1, 2)"


def rec(name: str, sql: str):
    return put(name, sql, recursive=True)


def _seeds(t: Tables):
    return t.symbols.select(F.col("id").alias("root"), F.col("id").alias("node"))


def _scc(t: Tables):
    return G.scc(t.symbols, t.graph)


rec("bfs_depths", _bfs("SELECT id FROM symbols", most=6) + " SELECT root, node, dist FROM bf WHERE dist > 0")(lambda s, d: G.bfs(Tables(s, d).graph, _seeds(Tables(s, d)), 6).filter("dist > 0").select("root", "node", "dist"))
rec(
    "blast_radius",
    CLO + ", n AS (SELECT count(*) AS n FROM symbols) SELECT dst AS root, count(*) AS dependents, count(DISTINCT src // 10) AS files, CASE WHEN count(*) >= 0.10::DOUBLE * any_value(n) OR count(*) >= 50 THEN 'high' WHEN count(*) >= 0.02::DOUBLE * any_value(n) OR count(*) >= 10 THEN 'medium' ELSE 'low' END AS verdict FROM clo, n WHERE src <> dst GROUP BY 1",
)(lambda s, d: G.blast_radius(Tables(s, d).symbols, Tables(s, d).graph, F.expr("src div 10")))
rec("transitive_closure", CLO + " SELECT src, dst FROM clo")(lambda s, d: G.closure(Tables(s, d).graph))
rec("propagation_cost", CLO + " SELECT round(count(*) / CAST((SELECT count(*) * (count(*) - 1) FROM v) AS DOUBLE), 9) AS cost FROM clo")(lambda s, d: (lambda t: G.closure(t.graph).agg(F.count(F.lit(1)).alias("c")).crossJoin(t.symbols.agg(F.count(F.lit(1)).alias("n"))).select(F.round(F.col("c") / (F.col("n") * (F.col("n") - 1)), 9).alias("cost")))(Tables(s, d)))
rec("scc", SCC + " SELECT id, scc FROM sc")(lambda s, d: _scc(Tables(s, d)))
rec("tangle_ratio", SCC + ", z AS (SELECT scc, count(*) AS n FROM sc GROUP BY 1) SELECT round(100.0 * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS tangle FROM z")(
    lambda s, d: _scc(Tables(s, d)).groupBy("scc").agg(F.count(F.lit(1)).alias("n")).agg(r6(100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("tangle"))
)
rec("condensation_layers", LAY + " SELECT id, layer FROM lay")(lambda s, d: G.layers(Tables(s, d).symbols, Tables(s, d).graph))
rec("layer_skips", LAY + " SELECT g.src, g.dst, b.layer - a.layer AS gap FROM graph g JOIN lay a ON a.id = g.src JOIN lay b ON b.id = g.dst WHERE abs(b.layer - a.layer) > 1")(lambda s, d: G.layer_edges(Tables(s, d).graph, G.layers(Tables(s, d).symbols, Tables(s, d).graph)).filter("abs(gap) > 1"))
put("layer_violations", ", lay AS (SELECT id, id % 5 AS layer FROM symbols) SELECT g.src, g.dst, round((a.layer - b.layer) / CAST(greatest((SELECT max(layer) FROM lay), 1) AS DOUBLE), 3) AS severity FROM graph g JOIN lay a ON a.id = g.src JOIN lay b ON b.id = g.dst WHERE a.layer > b.layer")(
    lambda s, d: G.violations(Tables(s, d).graph, Tables(s, d).symbols.select("id", (F.col("id") % 5).alias("layer")))
)
rec("connected_components", ", und AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph), walk AS (SELECT id AS node, id AS low FROM symbols UNION SELECT u.dst, w.low FROM walk w JOIN und u ON u.src = w.node WHERE w.low < u.dst) SELECT node AS id, min(low) AS component FROM walk GROUP BY 1")(lambda s, d: G.components(Tables(s, d).symbols, Tables(s, d).graph))
put("pagerank", None)(lambda s, d: G.pagerank(Tables(s, d).symbols, Tables(s, d).graph).select("id", F.round("rank", 9).alias("rank")))
rec(
    "pagerank_rounds",
    ", n AS (SELECT count(*) AS n FROM symbols), od AS (SELECT src, count(*) AS deg FROM graph GROUP BY 1), it AS (SELECT 0 AS k, s.id, 1.0::DOUBLE / n AS r FROM symbols s, n UNION ALL SELECT k, id, r FROM (SELECT x.k + 1 AS k, v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce((SELECT sum(p.r / od.deg) FROM it p JOIN graph g ON g.src = p.id JOIN od ON od.src = p.id WHERE g.dst = v.id), 0) + (SELECT coalesce(sum(p.r), 0) FROM it p WHERE p.id NOT IN (SELECT src FROM od)) / n) AS r FROM (SELECT DISTINCT k FROM it) x, symbols v, n WHERE x.k < 10)) SELECT id, round(r, 9) AS rank FROM it WHERE k = 10",
)(lambda s, d: G.pagerank(Tables(s, d).symbols, Tables(s, d).graph, rounds=10, tolerance=None).select("id", F.round("rank", 9).alias("rank")))
UND = ", und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM graph), u AS (SELECT x.cluster AS ca, y.cluster AS cb FROM und JOIN labelled x ON x.id = a JOIN labelled y ON y.id = b), vol AS (SELECT c, count(*) AS v, sum(x) AS cut FROM (SELECT ca AS c, CAST(ca <> cb AS INT) AS x FROM u UNION ALL SELECT cb, CAST(ca <> cb AS INT) FROM u) GROUP BY 1)"
put("modularity", UND + " SELECT round((SELECT avg(CAST(ca = cb AS INT)) FROM u) - sum(v * v) / (4.0 * (SELECT count(*) FROM u) * (SELECT count(*) FROM u)), 9) AS modularity FROM vol")(lambda s, d: G.modularity(Tables(s, d).graph, Tables(s, d).labels).select(F.round("modularity", 9).alias("modularity")))
put("conductance", UND + " SELECT c AS cluster, CAST(cut AS BIGINT) AS cut, v AS volume, round(CASE WHEN least(v, sum(v) OVER () - v) > 0 THEN cut / least(v, sum(v) OVER () - v) ELSE 0 END, 6) AS conductance FROM vol")(lambda s, d: G.conductance(Tables(s, d).graph, Tables(s, d).labels).withColumn("conductance", r6(F.col("conductance"))))
put("cluster_cohesion", ", u AS (SELECT x.cluster AS ca, y.cluster AS cb FROM graph JOIN labelled x ON x.id = src JOIN labelled y ON y.id = dst), e AS (SELECT ca AS cluster, CAST(ca = cb AS INT) AS i FROM u UNION ALL SELECT cb, 0 FROM u WHERE ca <> cb) SELECT cluster, CAST(sum(i) AS BIGINT) AS intra, count(*) AS total, round(avg(i), 6) AS share FROM e GROUP BY 1")(lambda s, d: G.cohesion(Tables(s, d).graph, Tables(s, d).labels).withColumn("share", r6(F.col("share"))))
put("conflict_probability", ", u AS (SELECT x.cluster AS ca, y.cluster AS cb FROM graph JOIN labelled x ON x.id = src JOIN labelled y ON y.id = dst) SELECT round(avg(CAST(ca <> cb AS INT)), 6) AS probability FROM u")(
    lambda s, d: (lambda t: t.graph.join(t.labels.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), "src").join(t.labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cb")), "dst").agg(r6(F.avg((F.col("ca") != F.col("cb")).cast("int"))).alias("probability")))(Tables(s, d))
)
rec("affected_tests", _bfs("SELECT id FROM symbols", a="dst", b="src", most=10) + " SELECT root, node, dist, CASE WHEN dist = 1 THEN 'DIRECT' ELSE 'TRANSITIVE' END AS kind FROM bf JOIN files f ON f.id = node // 10 WHERE is_test = 1 AND dist > 0")(
    lambda s, d: (lambda t: G.bfs(G.reverse(t.graph), _seeds(t), 10).filter("dist > 0").withColumn("id", F.expr("node div 10")).join(t.files.filter("is_test = 1").select("id"), "id", "left_semi").select("root", "node", "dist", F.when(F.col("dist") == 1, "DIRECT").otherwise("TRANSITIVE").alias("kind")))(Tables(s, d))
)
rec("gate_reach", _bfs("SELECT id FROM symbols WHERE id NOT IN (SELECT dst FROM graph) AND id IN (SELECT src FROM graph)", most=8) + " SELECT root, CAST(min(dist) AS BIGINT) AS dist FROM bf WHERE node % 25 = 0 GROUP BY 1")(
    lambda s, d: (lambda t: G.bfs(t.graph, t.graph.select("src").distinct().join(t.graph.select(F.col("dst").alias("src")), "src", "left_anti").select(F.col("src").alias("root"), F.col("src").alias("node")), 8).filter("node % 25 = 0").groupBy("root").agg(F.min("dist").alias("dist")))(Tables(s, d))
)
rec("vuln_reach", _bfs("SELECT id FROM symbols WHERE id NOT IN (SELECT dst FROM graph)") + ", best AS (SELECT node, min(dist) AS hops FROM bf GROUP BY 1) SELECT s.id, CAST(CASE WHEN hops IS NULL THEN -1 ELSE 1 END AS INTEGER) AS reachable, hops FROM symbols s LEFT JOIN best ON node = s.id")(
    lambda s, d: (lambda t: t.symbols.select("id").join(G.reach(t.graph, t.symbols.select(F.col("id").alias("node")).join(t.graph.select(F.col("dst").alias("node")), "node", "left_anti")), F.col("id") == F.col("node"), "left").select("id", F.when(F.col("dist").isNull(), -1).otherwise(1).alias("reachable"), F.col("dist").alias("hops")))(Tables(s, d))
)
DIRECT = "SELECT id, CASE id % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'database' ELSE 'filesystem' END AS effect FROM symbols WHERE id % 15 = 2"
rec("effects_propagated", CLO + f", direct AS ({DIRECT}), al AS (SELECT id, effect FROM direct UNION SELECT c.src, effect FROM clo c JOIN direct d ON d.id = c.dst) SELECT id, effect, CASE WHEN EXISTS (SELECT 1 FROM direct d WHERE d.id = al.id AND d.effect = al.effect) THEN 'direct' ELSE 'transitive' END AS source FROM al")(
    lambda s, d: (lambda t: G.effects(t.graph, t.symbols.filter("id % 15 = 2").select("id", F.expr("CASE id % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'database' ELSE 'filesystem' END").alias("effect"))))(Tables(s, d))
)
rec(
    "extinction",
    ", ex AS (SELECT 0 AS round, list(id) AS dead, list(id) AS new FROM symbols WHERE id % 9 = 4 UNION ALL SELECT round + 1, list_concat(dead, more), more FROM (SELECT round, dead, (SELECT coalesce(list(src), []) FROM (SELECT src, bool_and(list_contains(dead, dst)) AS gone FROM graph GROUP BY src) WHERE gone AND NOT list_contains(dead, src)) AS more FROM ex) WHERE len(more) > 0) SELECT unnest(new) AS id, CAST(round AS BIGINT) AS round FROM ex",
)(lambda s, d: G.extinction(Tables(s, d).graph, Tables(s, d).symbols.filter("id % 9 = 4").select("id")))
rec("safe_zone", _bfs("SELECT id FROM symbols WHERE id = 3", most=3) + ", wb AS (SELECT 3 AS node, 0 AS dist UNION SELECT g.src, dist + 1 FROM wb JOIN graph g ON g.dst = node WHERE dist < 3), zone AS (SELECT node AS id FROM bf UNION SELECT node FROM wb), und AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph) SELECT CAST(id AS BIGINT) AS id, CAST(EXISTS (SELECT 1 FROM und WHERE und.src = zone.id AND und.dst NOT IN (SELECT id FROM zone)) AS INTEGER) AS boundary FROM zone")(
    lambda s, d: G.safe_zone(Tables(s, d).graph, Tables(s, d).symbols.filter("id = 3").select("id"), 3)
)
put("betweenness", None)(lambda s, d: G.betweenness(Tables(s, d).symbols, Tables(s, d).graph).withColumn("betweenness", r6(F.col("betweenness"))))
put("edge_betweenness", None)(lambda s, d: G.betweenness(Tables(s, d).symbols, Tables(s, d).graph, of_edges=True).withColumn("betweenness", r6(F.col("betweenness"))))
put("louvain", None)(lambda s, d: G.louvain(Tables(s, d).symbols, Tables(s, d).graph))
put("k_paths", None)(lambda s, d: (lambda t: (lambda e: G.paths(t.edges, int(e["src"]), int(e["dst"])))(t.edges.orderBy("src", "dst").first()))(Tables(s, d)))
put("min_cut", None)(lambda s, d: G.min_cuts(Tables(s, d).graph, Tables(s, d).labels))
put("fiedler", None)(lambda s, d: s.createDataFrame([(G.fiedler(Tables(s, d).file_edges),)], "connectivity double"))
rec("distance_matrix", _bfs("SELECT id FROM symbols", most=8) + " SELECT root AS a, node AS b, dist FROM bf WHERE dist > 0")(lambda s, d: G.distance_matrix(Tables(s, d).graph, Tables(s, d).symbols.select("id")))
put("shared_callees", " SELECT dst AS id, count(DISTINCT src) AS callers FROM graph GROUP BY 1 HAVING count(DISTINCT src) >= 2")(lambda s, d: Tables(s, d).graph.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers")).filter("callers >= 2"))
