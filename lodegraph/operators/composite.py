"""Compositions of graph measures: topology fingerprint, health snapshot, partition for workers, preflight."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from . import graph as G
from . import scores as S


def snapshot(vertices: DataFrame, edges: DataFrame, file_health: DataFrame, god: int = 20, *, betweenness: DataFrame | None = None, layer: DataFrame | None = None, utility: DataFrame | None = None) -> DataFrame:
    """One row of health metrics: tangle, gods, necks (bottlenecks), violations, files (mean file health), score. `betweenness`
    (id, betweenness) and `layer` (id, layer) are made from the graph where not given; violations are edges to lower layers.
    Symbols in `utility` (id) are critical gods at three times the degree, critical bottlenecks at 1.5 times the percentile."""
    vertices, edges = cut(vertices.select("id")), cut(edges.select("src", "dst"))
    labels = cut(G.layered(vertices, edges))
    tangle = labels.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).agg((100.0 * F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("tangle"))
    slack = (utility if utility is not None else vertices.limit(0)).select("id").distinct().withColumn("slack", F.lit(1))
    lax = lambda x: F.when(F.col("slack").isNotNull(), x).otherwise(1.0)
    deg = edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") > god).orderBy(F.desc("d"), "id").limit(50)
    gods = deg.join(slack, "id", "left").agg((3 * F.count_if(F.col("d") > 50 * lax(3.0)) + 0.5 * F.count(F.lit(1))).cast("double").alias("gods"))
    b = (betweenness if betweenness is not None else G.betweenness(vertices, edges)).filter("betweenness > 0")
    p90 = b.agg(F.percentile("betweenness", F.lit(0.9)).alias("p90"))
    top = b.filter("betweenness > 0.5").orderBy(F.desc("betweenness"), "id").limit(15).join(slack, "id", "left").crossJoin(F.broadcast(p90))  # one row
    necks = top.agg((2 * F.count_if(F.col("betweenness") > F.col("p90") * lax(1.5)) + 0.3 * F.count(F.lit(1))).cast("double").alias("necks"))
    below = G.violations(edges, layer if layer is not None else labels.select("id", "layer")).agg(F.count(F.lit(1)).cast("double").alias("violations"))
    mean = file_health.agg(F.avg("health").alias("files"))
    d = tangle.crossJoin(gods).crossJoin(necks).crossJoin(below).crossJoin(mean)  # one row each
    return d.withColumn("score", S.health(F.col("tangle"), F.col("gods"), F.col("necks"), F.col("violations"), F.col("files")))


def fingerprint(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): layers, tangle, modularity of communities, Gini of ranks, hub ratio."""
    vertices, edges = cut(vertices.select("id")), cut(edges.select("src", "dst"))
    labels = cut(G.layered(vertices, edges))
    layers = labels.agg((F.max("layer") + 1).cast("double").alias("value")).select(F.lit("layers").alias("metric"), "value")
    tangle = labels.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("value")).select(F.lit("tangle").alias("metric"), "value")
    mod = G.modularity(edges, G.louvain(vertices, edges)).select(F.lit("modularity").alias("metric"), F.col("modularity").alias("value"))
    gini = S.gini(G.pagerank(vertices, edges, rounds=30), "rank").select(F.lit("rank_gini").alias("metric"), F.col("gini").alias("value"))
    deg = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
    hub = deg.agg(F.avg((F.col("d") >= 5).cast("double")).alias("value")).select(F.lit("hub_ratio").alias("metric"), "value")
    return layers.unionByName(tangle).unionByName(mod).unionByName(gini).unionByName(hub)


def distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: similarity of two fingerprints, 1 - normalised root mean square difference, 0 to 1."""
    d = a.join(b.withColumnRenamed("value", "other"), "metric")
    x = (F.col("value") - F.col("other")) / F.greatest(F.abs("value"), F.abs("other"), F.lit(1e-9))
    return d.agg(F.greatest(F.lit(0.0), 1 - F.sqrt(F.avg(x * x))).alias("similarity"))


def _sub(runs: list[tuple], lo: int, hi: int) -> list[tuple]:
    """Members lo to hi of runs (node, from, to) laid end to end."""
    out, at = [], 0
    for node, a, b in runs:
        x, y = max(lo - at, 0), min(hi - at, b - a)
        if x < y:
            out.append((node, a + x, a + y))
        at += b - a
    return out


def merged(sizes: list[tuple[int, int]], parts: int) -> list[tuple[int, int, int]]:
    """(lo, hi, part) by lo: clusters stand in order of size from position 0, sizes lists (size, clusters of it) rising; the two
    smallest are merged until `parts` are left, of equal ones those that came first. A size's clusters are paired in one step, so
    the work is by sizes. Part 0 is the largest."""
    groups: dict[int, list[tuple]] = {}
    at = 0
    for size, n in sizes:
        groups[size] = [(("first", at), 0, n)]
        at += n
    total, heap = at, sorted(groups)
    while total > parts:
        s = heapq.heappop(heap)
        runs = groups.pop(s)
        n = sum(b - a for _, a, b in runs)
        if n > 1:
            m = min(n // 2, total - parts)
            new, rest, size = (("pairs", _sub(runs, 0, 2 * m)), 0, m), _sub(runs, 2 * m, n), 2 * s
        else:
            m, size = 1, s + heap[0]
            s = heapq.heappop(heap)
            others = groups.pop(s)
            new, rest = (("both", [*runs, *_sub(others, 0, 1)]), 0, 1), _sub(others, 1, sum(b - a for _, a, b in others))
        for k, more in ((s, rest), (size, [new])):
            if more:
                if k not in groups:
                    heapq.heappush(heap, k)
                groups.setdefault(k, []).extend(more)
        total -= m
    found = []
    for size, runs in groups.items():
        for k in range(sum(b - a for _, a, b in runs)):
            todo, spans = _sub(runs, k, k + 1), []
            while todo:
                (kind, of), a, b = todo.pop()
                if kind == "first":
                    spans.append((of + a, of + b))
                else:
                    todo += _sub(of, 2 * a, 2 * b) if kind == "pairs" else of
            found.append((-size, sorted(spans)))
    return sorted((lo, hi, part) for part, (_, spans) in enumerate(sorted(found)) for lo, hi in spans)


def _split(labels: DataFrame, edges: DataFrame, sizes: list[tuple[int, int]], parts: int) -> DataFrame:
    """(id, part): the largest cluster is split until there are `parts` or none has two members: without its node of greatest
    betweenness, the largest component and that node, and the rest; halves by id where that leaves one component."""
    labels, sizes = labels.select("id", F.col("cluster").alias("part")), dict(sizes)
    labels = cut(labels)
    names = {old: k for k, (old, _) in enumerate(sorted(sizes.items(), key=lambda x: (-x[1], x[0])))}
    sizes = {names[k]: n for k, n in sizes.items()}
    labels = labels.join(F.broadcast(labels.sparkSession.createDataFrame(list(names.items()), "part long, no int")), "part").select("id", F.col("no").alias("part"))  # fewer than `parts` rows
    while 0 < len(sizes) < parts:
        big = min(sizes, key=lambda k: (-sizes[k], k))
        if sizes[big] < 2:
            break  # the parts that are left stay empty
        v = cut(labels.filter(F.col("part") == big).select("id"))
        inside = cut(edges.select("src", "dst").distinct().join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
        try:
            node = G.betweenness(v, inside).orderBy(F.desc(F.round("betweenness", 9)), "id").first()["id"]
        except ValueError:  # above its edge limit
            node = None
        go = None
        if node is not None:
            left = cut(G.components(v.filter(F.col("id") != node), inside.filter((F.col("src") != node) & (F.col("dst") != node))))
            top = left.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(2).collect()
            if len(top) > 1:
                go = left.filter(F.col("component") != top[0]["component"]).select("id")
        if go is None:
            half = v.orderBy("id").limit(sizes[big] // 2).agg(F.max("id")).first()[0]
            go = v.filter(F.col("id") > half)
        go = cut(go.withColumn("new", F.lit(len(sizes))))
        n = go.count()
        sizes[len(sizes)], sizes[big] = n, sizes[big] - n
        labels = cut(labels.join(go, "id", "left").select("id", F.coalesce("new", "part").alias("part")))
    return labels


def partition(vertices: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """(id, part): communities for `parts` workers. Of more communities than parts the two smallest are merged, of fewer the
    largest is split, until the numbers agree. The driver holds the number of communities of each size, not the communities."""
    c = cut(G.louvain(vertices, edges))
    n = c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    n = cut(n.orderBy("n", "cluster").withColumn("at", F.monotonically_increasing_id()))
    sizes = [(r["n"], r["c"]) for r in n.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()]
    if sum(k for _, k in sizes) < parts:
        return _split(c, edges, [(r["cluster"], r["n"]) for r in n.collect()], parts)  # fewer than `parts` rows
    held, start = {}, 0  # the first position of each partition of the order
    for r in n.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count(F.lit(1)).alias("c")).orderBy("p").collect():
        held[r["p"]], start = start, start + r["c"]
    spans = merged(sizes, parts)
    lows, nos = np.array([x[0] for x in spans], dtype="int64"), np.array([x[2] for x in spans], dtype="int32")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            at = d["at"].to_numpy()
            at = np.array([held[p] for p in (at >> 33).tolist()], dtype="int64") + (at & (2**33 - 1))
            yield pd.DataFrame({"cluster": d["cluster"], "part": nos[np.searchsorted(lows, at, side="right") - 1]})

    return c.join(n.select("cluster", "at").mapInPandas(place, "cluster long, part int"), "cluster").select("id", "part")


def worst(*levels: Column) -> Column:
    """The severest of OK, LOW, MEDIUM, HIGH, CRITICAL."""
    order = F.array(*map(F.lit, ("OK", "LOW", "MEDIUM", "HIGH", "CRITICAL")))
    return F.element_at(order, F.greatest(F.lit(1), *[F.array_position(order, x).cast("int") for x in levels]))


def preflight(degree: Column, complexity: Column, tests: Column) -> Column:
    """Overall severity of blast radius, complexity and missing tests."""
    blast = F.when(degree >= 10, "HIGH").when(degree >= 3, "MEDIUM").otherwise("OK")
    cc = F.when(complexity >= 40, "CRITICAL").when(complexity >= 25, "HIGH").when(complexity >= 15, "MEDIUM").otherwise("OK")
    return worst(blast, cc, F.when(tests == 0, "LOW").otherwise("OK"))
