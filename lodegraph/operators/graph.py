"""Graph operators over edges (src, dst). Iterations join a frontier with the edges, cut lineage by checkpoint in the shared
folder, and end on an emptiness test; nothing but counts reaches the driver except where a docstring bounds it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut, discard, staged


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def bfs(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(root, node, dist, via, parent) for seeds (root, node): shortest distances, the first-hop node and the parent, both the
    smallest ids among shortest paths. Seeds have dist 0 and no via or parent. `hops` bounds the distance; None: no bound."""
    frontier = cut(seeds.select("root", "node").distinct().select("root", "node", F.lit(0).cast("long").alias("dist"), F.lit(None).cast("long").alias("via"), F.lit(None).cast("long").alias("parent")))
    found, step = frontier, 0
    e = cut(edges.select("src", "dst").distinct())
    while hops is None or step < hops:
        step += 1
        nxt = frontier.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.coalesce("via", "dst").alias("via"), F.col("node").alias("parent"))
        nxt = nxt.groupBy("root", "node").agg(F.min("via").alias("via"), F.min("parent").alias("parent")).join(found.select("root", "node"), ["root", "node"], "left_anti")
        frontier = cut(nxt.select("root", "node", F.lit(step).cast("long").alias("dist"), "via", "parent"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        found = cut(found) if step % 16 == 0 else found
    return found


def reach(edges: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """(node, dist): distance from the nearest of the seeds (node)."""
    return bfs(edges, seeds.select(F.lit(0).cast("long").alias("root"), "node"), hops).select("node", "dist")


def closure(edges: DataFrame, in_one: int | None = None) -> DataFrame:
    """(src, dst) reachable in one step or more; nodes on cycles reach themselves. Components of at most `in_one` edges are walked
    from every source in tasks, larger ones semi-naively in Spark. The result's size is the caller's to bound (condense large
    graphs first)."""
    small, large, bins = pieces(edges, IN_ONE_TASK if in_one is None else in_one)
    found = None
    if small is not None:
        size = Window.partitionBy("bin")
        shares = small.withColumn("shares", F.ceil(F.count(F.lit(1)).over(size) / A_TASK))  # of the sources: each has all edges of the bin
        shares = shares.select("src", "dst", "bin", "shares", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
        found = shares.repartition(2 * bins, "bin", "share").groupBy("bin", "share").applyInPandas(_reached, "src long, dst long")
    if large is not None:
        far = _spread_closure(large)
        found = far if found is None else found.unionByName(far)
    return found if found is not None else edges.select("src", "dst").limit(0)


def _reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs of one share's sources, in batches; one source's walk is held at a time."""
    d = pd.concat(batches)
    share, shares = int(d["share"].iloc[0]), int(d["shares"].iloc[0])
    ids, ends = np.unique(d[["src", "dst"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    to: dict[int, list[int]] = {}
    for a, b in ends[np.lexsort((ends[:, 1], ends[:, 0]))].tolist():
        to.setdefault(a, []).append(b)
    src, count, dst = [], [], []
    for s in sorted(to)[share::shares]:
        seen = set(to[s])
        queue = list(seen)
        for v in queue:
            for w in to.get(v, ()):
                if w not in seen:
                    seen.add(w)
                    queue.append(w)
        src.append(s)
        count.append(len(queue))
        dst += queue
        if len(dst) > 500_000:
            yield pd.DataFrame({"src": np.repeat(ids[src], count), "dst": ids[dst]})
            src, count, dst = [], [], []
    if src:
        yield pd.DataFrame({"src": np.repeat(ids[src], count), "dst": ids[dst]})


def _spread_closure(edges: DataFrame) -> DataFrame:
    """The same for a component of any size, round after round."""
    e = cut(edges.select("src", "dst").distinct())
    known, delta = e, e
    while True:
        step = e.select(F.col("src").alias("m"), F.col("dst").alias("far"))
        more = delta.join(step, F.col("dst") == F.col("m")).select("src", F.col("far").alias("dst")).distinct().join(known, ["src", "dst"], "left_anti")
        delta = cut(more)
        if delta.isEmpty():
            return known
        known = cut(known.unionByName(delta))


def contracted(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every node of `links`: connected components by repeated contraction. Each round every node takes the
    neighbour of smallest hash (or itself); only links between different roots go to the next round, so edges vanish and
    rounds are logarithmic. A root is one of its component's nodes. Null ends link nothing."""
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    edges = staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("low")).select("a", F.least(rank(F.col("a")), F.col("low"))["v"].alias("up"))
        up = staged(up, "up")
        old = labels
        if labels is None:
            labels = up.select(F.col("a").alias("id"), F.col("up").alias("root"))
        else:
            labels = staged(labels.join(up, F.col("root") == F.col("a"), "left").select("id", F.coalesce("up", "root").alias("root")), "labels")
        one, two = up.select(F.col("a").alias("x"), F.col("up").alias("ua")), up.select(F.col("a").alias("y"), F.col("up").alias("ub"))
        left = edges.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")).select(F.col("ua").alias("a"), F.col("ub").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        left = staged(left, "edges")
        discard(edges, old)
        edges = left
        if edges.isEmpty():
            discard(edges)
            return labels


def blast_radius(vertices: DataFrame, edges: DataFrame, file: Column) -> DataFrame:
    """(root, dependents, files, verdict) of every node that others reach: how many nodes reach it in any number of steps, the
    files (an expression of src) that they lie in, and a verdict by their number and share."""
    reached = closure(edges).filter("src <> dst")
    n = vertices.agg(F.count(F.lit(1)).alias("n"))
    d = reached.groupBy(F.col("dst").alias("root")).agg(F.count(F.lit(1)).alias("dependents"), F.count_distinct(file).alias("files")).crossJoin(F.broadcast(n))  # one row
    share = F.col("dependents") / F.col("n")
    verdict = F.when((share >= 0.10) | (F.col("dependents") >= 50), "high").when((share >= 0.02) | (F.col("dependents") >= 10), "medium").otherwise("low")
    return d.select("root", "dependents", "files", verdict.alias("verdict"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): undirected components named by their smallest id, by contraction; a vertex without edges is its own."""
    roots = contracted(edges, "src", "dst")
    names = roots.groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(names, "root").select(F.col("id").alias("k"), "component")
    return vertices.select("id").join(named, F.col("id") == F.col("k"), "left").select("id", F.coalesce("component", "id").alias("component"))


#: Edges that one task may hold (two numbers each, 16 MB); larger components take the distributed way.
IN_ONE_TASK = 1_000_000
#: Edges that small components are dealt to a task by.
A_TASK = 20_000


def pieces(edges: DataFrame, in_one: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """(small, large, bins): the distinct edges of components of at most `in_one` edges as (src, dst, bin), whole components to a
    bin of about A_TASK edges, and those of larger components as (src, dst). A graph that fits one bin isn't searched for
    components. Loops stay; edges with a null end link nothing and go."""
    e = cut(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    n = e.count()
    if n <= min(A_TASK, in_one):
        return (e.withColumn("bin", F.lit(0).cast("long")) if n else None), None, 1
    if in_one <= 0:
        return None, e, 1
    roots = contracted(e, "src", "dst").select(F.col("id").alias("k"), "root")
    e = cut(e.join(roots, F.col("src") == F.col("k"), "left").select("src", "dst", F.coalesce("root", "src").alias("root")))
    bins = -(-n // A_TASK)
    large = e.groupBy("root").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > in_one).select("root")
    large = large.collect() if n > in_one else []  # at most n / in_one components
    over = F.col("root").isin([r["root"] for r in large])
    small = (e.filter(~over) if large else e).select("src", "dst", F.pmod(F.xxhash64("root"), F.lit(bins)).alias("bin"))
    return small, e.filter(over).select("src", "dst") if large else None, bins


def _by_bin(small: DataFrame, bins: int, run, schema: str) -> DataFrame:
    """`run` on each bin; a number of partitions is named, as the planner would put all bins into few tasks by their bytes."""
    return small.repartition(2 * bins, "bin").groupBy("bin").applyInPandas(run, schema)


def _tarjan(edges: pd.DataFrame) -> pd.DataFrame:
    """(id, scc, layer) of every node of a graph that fits one task: Tarjan's components and the longest path from a source over
    them; iterative, so depth doesn't matter."""
    ids, ends = np.unique(edges[["src", "dst"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    start = np.searchsorted(ends[:, 0], np.arange(len(ids) + 1)).tolist()
    to, n = ends[:, 1].tolist(), len(ids)
    index, low, on, at, stack, label, count, order = [-1] * n, [0] * n, [False] * n, start[:-1], [], [0] * n, 0, []
    for root in range(n):
        if index[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if index[v] < 0:
                index[v] = low[v] = count
                count += 1
                stack.append(v)
                on[v] = True
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    path.append(w)
                elif on[w]:
                    low[v] = min(low[v], index[w])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == index[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(stack.pop())
                name = max(members)
                for w in members:
                    on[w], label[w] = False, name
                order.append(members)
    layer = [0] * n
    for members in reversed(order):  # a component comes after all that it reaches
        up = layer[label[members[0]]] + 1
        for v in members:
            for w in to[start[v] : start[v + 1]]:
                if label[w] != label[v] and layer[label[w]] < up:
                    layer[label[w]] = up
    return pd.DataFrame({"id": ids, "scc": ids[label], "layer": np.array(layer, dtype="int64")[label]})


def scc(vertices: DataFrame, edges: DataFrame, in_one: int | None = None) -> DataFrame:
    """(id, scc): strongly connected components named by their largest id. Connected components of at most `in_one` edges are
    solved in tasks, larger ones by `_spread_scc`."""
    in_one = IN_ONE_TASK if in_one is None else in_one
    small, large, bins = pieces(edges.filter("src <> dst"), in_one)
    done = None if small is None else _by_bin(small, bins, _tarjan, "id long, scc long, layer long").select("id", "scc")
    if large is not None:
        far = _spread_scc(large, in_one)
        done = far if done is None else done.unionByName(far)
    if done is None:
        return vertices.select("id", F.col("id").alias("scc"))
    return vertices.select("id").join(done, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"))


def _spread_scc(edges: DataFrame, in_one: int) -> DataFrame:
    """(id, scc) of nodes on cycles and some others. Sources and sinks are trimmed; a rest of at most `in_one` edges is solved in
    one task. Of a larger one, the largest id that reaches a node colours it, and what reaches a colour's root backwards
    inside the colour is its component; repeat on what is left."""
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    done, size = None, left.count()
    while size > in_one:
        inner = left.select(F.col("src").alias("k")).intersect(left.select(F.col("dst").alias("k")))
        kept = cut(left.join(inner.select(F.col("k").alias("src")), "src", "left_semi").join(inner.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst"))
        left, before, size = kept, size, kept.count()
        if size < before or size <= in_one:
            continue
        nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = cut(nodes.select("id", F.col("id").alias("c")))
        while True:
            top = left.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("top"))
            new = cut(colour.join(top, F.col("id") == F.col("dst"), "left").select("id", F.greatest("c", F.coalesce("top", "c")).alias("c"), F.col("c").alias("old")))
            colour = new.select("id", "c")
            if new.filter("c <> old").isEmpty():
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = cut(left.join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst"))
        roots = colour.filter("id = c")
        back = bfs(reverse(inside), roots.select(F.col("id").alias("root"), F.col("id").alias("node"))).select(F.col("node").alias("id"), F.col("root").alias("scc"))
        done = cut(back if done is None else done.unionByName(back))
        gone = done.select(F.col("id").alias("src"))
        left = cut(left.join(gone, "src", "left_anti").join(gone.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"))
        size = left.count()
    if size:
        rest = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_tarjan, "id long, scc long, layer long").select("id", "scc")
        done = rest if done is None else done.unionByName(rest)
    return done if done is not None else edges.sparkSession.createDataFrame([], "id long, scc long")


def condensed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct edges between components."""
    a, b = labels.select(F.col("id").alias("src"), F.col("scc").alias("a")), labels.select(F.col("id").alias("dst"), F.col("scc").alias("b"))
    return edges.join(a, "src").join(b, "dst").filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def layered(vertices: DataFrame, edges: DataFrame, in_one: int | None = None) -> DataFrame:
    """(id, scc, layer): components as of `scc`, and the longest path from sources over the condensation."""
    in_one = IN_ONE_TASK if in_one is None else in_one
    small, large, bins = pieces(edges.filter("src <> dst"), in_one)
    done = None if small is None else _by_bin(small, bins, _tarjan, "id long, scc long, layer long")
    if large is not None:
        nodes = large.select(F.col("src").alias("id")).union(large.select("dst")).distinct()
        labels = cut(nodes.join(_spread_scc(large, in_one), "id", "left").select("id", F.coalesce("scc", "id").alias("scc")))
        far = labels.join(_spread_layers(large, labels), "id").select("id", "scc", "layer")
        done = far if done is None else done.unionByName(far)
    if done is None:
        return vertices.select("id", F.col("id").alias("scc"), F.lit(0).cast("long").alias("layer"))
    return vertices.select("id").join(done, "id", "left").select("id", F.coalesce("scc", "id").alias("scc"), F.coalesce("layer", F.lit(0)).alias("layer"))


def layers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer): longest path from sources over the condensation."""
    return layered(vertices, edges).select("id", "layer")


def _spread_layers(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, layer) for components of any size, a round a layer."""
    dag = cut(condensed(edges, labels))
    layer = cut(labels.select(F.col("scc").alias("id")).distinct().select("id", F.lit(0).cast("long").alias("layer")))
    while True:
        up = dag.join(layer, F.col("src") == F.col("id")).groupBy("dst").agg((F.max("layer") + 1).alias("up"))
        new = cut(layer.join(up, F.col("id") == F.col("dst"), "left").select("id", F.greatest("layer", F.coalesce("up", "layer")).alias("layer"), F.col("layer").alias("old")))
        layer = new.select("id", "layer")
        if new.filter("layer <> old").isEmpty():
            break
    return labels.join(layer.select(F.col("id").alias("scc"), "layer"), "scc").select("id", "layer")


def layer_edges(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """(src, dst, gap): layer of dst minus layer of src."""
    a, b = layer.select(F.col("id").alias("src"), F.col("layer").alias("ls")), layer.select(F.col("id").alias("dst"), F.col("layer").alias("ld"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("ld") - F.col("ls")).alias("gap"))


def violations(edges: DataFrame, layer: DataFrame) -> DataFrame:
    """Edges that point to a lower layer, with severity gap / highest layer."""
    top = layer.agg(F.greatest(F.max("layer"), F.lit(1)).alias("top"))
    return layer_edges(edges, layer).filter("gap < 0").crossJoin(F.broadcast(top)).select("src", "dst", F.round(-F.col("gap") / F.col("top"), 3).alias("severity"))


def pagerank(vertices: DataFrame, edges: DataFrame, *, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, rank): power iteration with uniform teleport; dangling mass spreads uniformly; ends on an L1 change below
    tolerance * n, or after `rounds` with tolerance None. The degrees are attached once; a round is one join and one sum."""
    n = vertices.count()
    if n == 0:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    e = edges.select("src", "dst").distinct()
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    e = cut(e.join(deg, "src"))
    rank = cut(vertices.select("id").join(deg, F.col("id") == F.col("src"), "left").select("id", F.col("src").isNull().alias("dangling"), F.lit(1.0 / n).alias("rank")))
    lost = rank.filter("dangling").count() / n
    for _ in range(rounds):
        got = e.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        new = rank.join(got, F.col("id") == F.col("dst"), "left").select("id", "dangling", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n))).alias("rank"), F.col("rank").alias("old"))
        new = cut(new)
        rank = new.drop("old")
        one = new.agg(F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("lost"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("moved")).first()
        lost = one["lost"] or 0.0
        if tolerance is not None and one["moved"] < tolerance * n:
            break
    return rank.select("id", "rank")


def _brandes(adjacency: dict[int, list[int]], s: int) -> tuple[dict[int, float], dict[tuple[int, int], float]]:
    order, before, paths, dist = [], {s: []}, {s: 1.0}, {s: 0}
    queue = [s]
    for v in queue:
        order.append(v)
        for w in adjacency.get(v, ()):
            if w not in dist:
                dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                queue.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
                before[w].append(v)
    share, nodes, lines = dict.fromkeys(order, 0.0), {}, {}
    for w in reversed(order):
        for v in before[w]:
            c = paths[v] / paths[w] * (1 + share[w])
            share[v] += c
            lines[v, w] = lines.get((v, w), 0.0) + c
        if w != s:
            nodes[w] = share[w]
    return nodes, lines


def betweenness(vertices: DataFrame, edges: DataFrame, *, exact: int = 1000, edge_limit: int = 2_000_000, of_edges: bool = False, seed: int = 42) -> DataFrame:
    """Unnormalised betweenness (id, betweenness), or of edges (src, dst, betweenness). Pivots are dealt over tasks that hold
    the adjacency, whose size is checked: above `edge_limit` edges it raises ValueError (about 200 MB a task). Exact up to
    `exact` vertices, else max(200, 5 sqrt n) pivots of smallest seeded hash, scaled by n / pivots."""
    spark = vertices.sparkSession
    e = cut(edges.select("src", "dst").distinct())
    m = e.count()
    if m > edge_limit:
        raise ValueError(f"{m} edges; the limit of the adjacency that tasks hold is {edge_limit}")
    n = vertices.count()
    k = n if n <= exact else min(n, max(200, int(5 * n**0.5)))
    adjacency: dict[int, list[int]] = {}
    for r in e.orderBy("src", "dst").toLocalIterator():
        adjacency.setdefault(r["src"], []).append(r["dst"])
    held = spark.sparkContext.broadcast(adjacency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for s in b["id"]:
                for key, v in _brandes(held.value, int(s))[of_edges].items():
                    total[key] = total.get(key, 0.0) + v
        if of_edges:
            yield pd.DataFrame([(a, b, v) for (a, b), v in total.items()], columns=["src", "dst", "part"])
        else:
            yield pd.DataFrame(list(total.items()), columns=["id", "part"])

    pivots = vertices.select("id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).repartition(max(8, min(200, k // 25)), "id")
    keys = ["src", "dst"] if of_edges else ["id"]
    parts = pivots.mapInPandas(run, ", ".join(f"{c} long" for c in keys) + ", part double").groupBy(*keys).agg((F.sum("part") * (n / max(k, 1))).alias("betweenness"))
    base = e if of_edges else vertices.select("id")
    return base.join(parts, keys, "left").fillna(0.0, ["betweenness"])


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: Newman modularity of the undirected graph under (id, cluster)."""
    u = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    x, y = labels.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    u = u.join(x, "a").join(y, "b")
    m = u.agg(F.count(F.lit(1)).alias("m"), F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"))
    vol = u.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("v2"))
    return m.crossJoin(vol).select((F.col("inside") / F.col("m") - F.col("v2") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def conductance(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, cut, volume, conductance): cut over the smaller of volume and the rest's volume."""
    u = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    x, y = labels.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), labels.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    u = u.join(x, "a").join(y, "b")
    ends = u.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), (F.col("ca") != F.col("cb")).cast("long").alias("x")), F.struct(F.col("cb").alias("c"), (F.col("ca") != F.col("cb")).cast("long").alias("x")))).alias("e"))
    g = ends.groupBy(F.col("e.c").alias("cluster")).agg(F.sum("e.x").alias("cut"), F.count(F.lit(1)).alias("volume"))
    all_ = F.sum("volume").over(Window.partitionBy(F.lit(0)))
    small = F.least(F.col("volume"), all_ - F.col("volume"))
    return g.select("cluster", "cut", "volume", F.when(small > 0, F.col("cut") / small).otherwise(0.0).alias("conductance"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, intra, total, share) of edges that touch it."""
    x, y = labels.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    u = edges.join(x, "src").join(y, "dst")
    d = u.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("cluster"), (F.col("ca") == F.col("cb")).cast("long").alias("i"))
    return d.groupBy("cluster").agg(F.sum("i").alias("intra"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("intra") / F.col("total"))


def _moves(near: DataFrame, deg: DataFrame, m2: float) -> DataFrame:
    """(id, c): labels after local moves on the weighted graph (x, y, w; both directions, loops kept out; deg: x, k with loops).
    A vertex moves to the neighbour cluster of greatest gain; in each round only vertices of one hash parity move and ties go
    to the smaller label. Ends when neither parity moves, or when no round raised modularity further."""
    lab = cut(deg.select(F.col("x").alias("id"), F.col("x").alias("c")))
    best_q, best, r, idle, worse = None, lab, 0, 0, 0
    while idle < 2 and worse < 4:
        vol = lab.join(deg, F.col("id") == F.col("x")).groupBy("c").agg(F.sum("k").alias("vol"))
        by = near.join(lab.select(F.col("id").alias("y"), F.col("c").alias("cy")), "y").groupBy("x", "cy").agg(F.sum("w").alias("w"))
        by = by.join(lab.select(F.col("id").alias("x"), F.col("c").alias("cx")), "x").join(deg, "x").join(vol.select(F.col("c").alias("cy"), "vol"), "cy").join(vol.select(F.col("c").alias("cx"), F.col("vol").alias("volx")), "cx")
        same = F.col("cy") == F.col("cx")
        by = by.withColumn("gain", F.col("w") - F.col("k") * (F.col("vol") - F.when(same, F.col("k")).otherwise(0)) / m2)
        top = by.groupBy("x").agg(F.max(F.struct("gain", (-F.col("cy")).alias("c"))).alias("t"), F.coalesce(F.max(F.when(same, F.col("gain"))), F.max(-F.col("k") * (F.col("volx") - F.col("k")) / m2)).alias("stay"))
        moves = top.filter((F.col("t.gain") > F.col("stay") + 1e-9) & (F.pmod(F.xxhash64("x", F.lit(r // 2)), F.lit(2)) == r % 2)).select("x", (-F.col("t.c")).alias("to"))
        new = cut(lab.join(moves, F.col("id") == F.col("x"), "left").select("id", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
        lab, r = new.select("id", "c"), r + 1
        idle = idle + 1 if new.filter("moved").isEmpty() else 0
        if idle == 0:
            a, b = lab.select(F.col("id").alias("x"), F.col("c").alias("cx")), lab.select(F.col("id").alias("y"), F.col("c").alias("cy"))
            inner = near.join(a, "x").join(b, "y").filter("cx = cy").agg(F.sum("w").alias("i"))
            square = lab.join(deg, F.col("id") == F.col("x")).groupBy("c").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("s"))
            one = inner.crossJoin(square).first()
            q = (one["i"] or 0) / m2 - one["s"] / (m2 * m2)
            if best_q is None or q > best_q + 1e-9:
                best_q, best, worse = q, lab, 0
            else:
                worse += 1
    return best


def _communities(d: pd.DataFrame, m2: float) -> pd.DataFrame:
    """(id, c): Louvain on whole components that fit one task, given by (x, y, w) both ways round with x's degree k, which counts
    loops: vertices move in order of id to the neighbour cluster of greatest gain until none gains, then clusters are contracted;
    until a level moves nothing. m2, twice the weight of the whole graph, is all that one component needs to know of others."""
    ids, x = np.unique(d["x"].to_numpy(), return_inverse=True)
    y = np.searchsorted(ids, d["y"].to_numpy())
    near: list[dict[int, float]] = [{} for _ in ids]
    k = np.zeros(len(ids))
    k[x] = d["k"].to_numpy()
    k = k.tolist()
    at = np.lexsort((y, x))
    for a, b, w in zip(x[at].tolist(), y[at].tolist(), d["w"].to_numpy()[at].tolist(), strict=True):
        near[a][b] = w
    own = np.arange(len(ids))
    while True:
        lab, vol, moved = list(range(len(near))), list(k), 0
        before = -1
        while moved != before:
            before = moved
            for v, around in enumerate(near):
                by: dict[int, float] = {}
                for u, w in around.items():
                    c = lab[u]
                    by[c] = by.get(c, 0.0) + w
                c, kv = lab[v], k[v]
                vol[c] -= kv
                best, gain = c, by.get(c, 0.0) - kv * vol[c] / m2 + 1e-9
                for to, w in by.items():
                    got = w - kv * vol[to] / m2
                    if got > gain or (got == gain and best != c and to < best):
                        best, gain = to, got
                vol[best] += kv
                if best != c:
                    lab[v], moved = best, moved + 1
        if not moved:
            break
        names = {c: i for i, c in enumerate(sorted(set(lab)))}
        lab = [names[c] for c in lab]
        own = np.array(lab)[own]
        joined: list[dict[int, float]] = [{} for _ in names]
        degree = [0.0] * len(names)
        for v, around in enumerate(near):
            c = lab[v]
            degree[c] += k[v]
            for u, w in around.items():
                if lab[u] != c:
                    joined[c][lab[u]] = joined[c].get(lab[u], 0.0) + w
        near, k = joined, degree
    first = np.full(len(near), len(ids))
    np.minimum.at(first, own, np.arange(len(ids)))
    return pd.DataFrame({"id": ids, "c": ids[first[own]]})


def louvain(vertices: DataFrame, edges: DataFrame, in_one: int | None = None) -> DataFrame:
    """(id, cluster): communities by Louvain's two phases, deterministic: local moves until none raises modularity, then
    clusters are contracted to weighted vertices; repeated until a level moves nothing. Connected components of at most `in_one`
    edges are solved in tasks; of larger ones a level is moved in Spark, and what it leaves is divided again. Isolated
    vertices stay alone."""
    in_one = IN_ONE_TASK if in_one is None else in_one
    u = edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    near = cut(u.select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(1.0).alias("w")).unionByName(u.select(F.col("dst").alias("x"), F.col("src").alias("y"), F.lit(1.0).alias("w"))))
    m2 = float(max(1, near.count()))
    deg = cut(near.groupBy("x").agg(F.sum("w").alias("k")))
    labels = deg.select(F.col("x").alias("id"), F.col("x").alias("cluster"))
    while True:
        small, large, bins = pieces(near.filter("x < y").select(F.col("x").alias("src"), F.col("y").alias("dst")), in_one)
        known = None
        if small is not None:
            ends = small.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), "bin")
            ends = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), "bin"))
            known = cut(_by_bin(near.join(ends, ["x", "y"]).join(deg, "x"), bins, lambda d: _communities(d, m2), "id long, c long"))
        moved, again = known, False
        if large is not None:
            ends = large.unionByName(reverse(large)).select(F.col("src").alias("x"), F.col("dst").alias("y"))
            near = cut(near.join(ends, ["x", "y"]))
            deg = cut(deg.join(near.select("x").distinct(), "x", "left_semi"))
            far = _moves(near, deg, m2)
            again = not far.filter("id <> c").isEmpty()
            moved = far if known is None else cut(known.unionByName(far))
        if moved is not None:
            labels = cut(labels.join(moved.select(F.col("id").alias("cluster"), "c"), "cluster", "left").select("id", F.coalesce("c", "cluster").alias("cluster")))
        if not again:
            break
        deg = cut(deg.join(far, F.col("x") == F.col("id")).groupBy(F.col("c").alias("x")).agg(F.sum("k").alias("k")))
        a, b = far.select(F.col("id").alias("x"), F.col("c").alias("cx")), far.select(F.col("id").alias("y"), F.col("c").alias("cy"))
        near = cut(near.join(a, "x").join(b, "y").filter("cx <> cy").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")))
    names = labels.groupBy("cluster").agg(F.min("id").alias("name"))
    labels = labels.join(names, "cluster").select(F.col("id").alias("k"), F.col("name").alias("cluster"))
    return vertices.select("id").join(labels, F.col("id") == F.col("k"), "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def effects(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """(id, effect, source): effects of a symbol, direct or of anything it reaches."""
    facts = cut(direct.select("id", "effect").distinct())
    known, delta = facts, facts
    back = cut(edges.select(F.col("src").alias("caller"), F.col("dst").alias("id")).distinct())
    while True:
        delta = cut(delta.join(back, "id").select(F.col("caller").alias("id"), "effect").distinct().join(known, ["id", "effect"], "left_anti"))
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
    own = facts.withColumn("d", F.lit(1))
    return known.join(own, ["id", "effect"], "left").select("id", "effect", F.when(F.col("d") == 1, "direct").otherwise("transitive").alias("source"))


def extinction(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id, round): what dies when `start` (id) goes: callers all of whose callees are gone, round after round."""
    e = cut(edges.select("src", "dst").distinct())
    dead = cut(start.select("id", F.lit(0).cast("long").alias("round")).distinct())
    step = 0
    while True:
        step += 1
        touched = e.join(dead.select(F.col("id").alias("dst")), "dst", "left_semi").select("src").distinct()
        alive = e.join(dead.select(F.col("id").alias("dst")), "dst", "left_anti").select("src").distinct()
        new = touched.join(alive, "src", "left_anti").select(F.col("src").alias("id")).join(dead, "id", "left_anti")
        new = cut(new.select("id", F.lit(step).cast("long").alias("round")))
        if new.isEmpty():
            return dead
        dead = cut(dead.unionByName(new))


def paths(edges: DataFrame, source: int, target: int, *, most: int = 4, k: int = 3) -> DataFrame:
    """(cost, path): the k cheapest simple paths up to `most` edges; a call costs 1, an import 1.1, else 2."""
    e = cut(edges.groupBy("src", "dst").agg(F.min(F.when(F.col("kind") == "call", 1.0).when(F.col("kind") == "import", 1.1).otherwise(2.0)).alias("w")))
    near = reach(reverse(e), e.sparkSession.createDataFrame([(target,)], "node long"), most).select("node", F.col("dist").alias("togo"))
    near = cut(near)
    frontier = e.sparkSession.createDataFrame([([source], 0.0)], "path array<long>, cost double")
    found = None
    for step in range(1, most + 1):
        tip = F.element_at("path", -1)
        nxt = frontier.withColumn("tip", tip).join(e, F.col("tip") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        nxt = nxt.join(near, F.col("dst") == F.col("node")).filter(F.col("togo") <= most - step)
        frontier = cut(nxt.select(F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("w")).alias("cost")))
        done = frontier.filter(F.element_at("path", -1) == target)
        found = done if found is None else found.unionByName(done)
        frontier = frontier.filter(F.element_at("path", -1) != target)
    return found.orderBy("cost", "path").limit(k).select(F.round("cost", 6).alias("cost"), "path")


def _lanczos(both: DataFrame) -> float:
    """Second smallest eigenvalue of the Laplacian of a connected graph, given by its edges both ways round. Lanczos steps with
    the constant vector projected out; the vectors stay in Spark, only sums reach the driver. Ends when the Ritz
    value's residual, which bounds its error, is under 1e-7."""
    deg = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("deg"))
    state = cut(deg.select("id", "deg", (F.xxhash64(F.lit(42), "id") / F.lit(2.0**63)).alias("w"), F.lit(0.0).alias("v")))
    alpha, beta, diagonal, beside = 0.0, 0.0, [], []
    mean = state.agg(F.avg("w")).first()[0]
    while True:
        state = state.select("id", "deg", (F.col("w") - alpha * F.col("v") - mean).alias("w"), F.col("v").alias("u"))
        beta = state.agg(F.sum(F.col("w") * F.col("w"))).first()[0] ** 0.5
        if diagonal:
            values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
            if beta * abs(vectors[-1, 0]) < 1e-7:
                return float(values[0])
            beside.append(beta)
        state = state.select("id", "deg", (F.col("w") / beta).alias("v"), "u")
        pulled = both.join(state.select(F.col("id").alias("dst"), "v"), "dst").groupBy("src").agg(F.sum("v").alias("s"))
        w = F.col("deg") * F.col("v") - F.col("s") - (beta if diagonal else 0.0) * F.col("u")
        state = cut(state.join(pulled, F.col("id") == F.col("src")).select("id", "deg", w.alias("w"), "v"))
        alpha, mean, drift = state.agg(F.sum(F.col("w") * F.col("v")), F.avg("w"), F.avg("v")).first()
        mean -= alpha * drift  # else the constant vector grows back
        diagonal.append(alpha)


def fiedler(edges: DataFrame, limit: int = 3000) -> float:
    """Algebraic connectivity of the largest undirected component, to 6 digits; 0 below 3 nodes. The Laplacian of up to `limit`
    nodes is dense on the driver; larger components iterate in Spark."""
    u = cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    nodes = u.select(F.col("src").alias("id")).union(u.select("dst")).distinct()
    comp = components(nodes, u)
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").first()
    if top is None or top["n"] < 3:
        return 0.0
    inside = u.join(comp.filter(F.col("component") == top["component"]).select(F.col("id").alias("src")), "src", "left_semi")
    if top["n"] > limit:
        return round(_lanczos(cut(inside.unionByName(reverse(inside)))), 6)
    rows = inside.collect()  # `limit` nodes at most
    ids = sorted({x for r in rows for x in (r["src"], r["dst"])})
    at = {v: i for i, v in enumerate(ids)}
    lap = np.zeros((len(ids), len(ids)))
    for r in rows:
        i, j = at[r["src"]], at[r["dst"]]
        lap[i, j] = lap[j, i] = -1
        lap[i, i] += 1
        lap[j, j] += 1
    return round(float(np.linalg.eigvalsh(lap)[1]), 6)


def _flow(lines: list[tuple[int, int]], s: int, t: int) -> int:
    cap: dict[int, dict[int, int]] = {}
    for a, b in lines:
        cap.setdefault(a, {})[b] = 1
        cap.setdefault(b, {})[a] = 1
    total = 0
    while True:
        before, queue = {s: s}, [s]
        for v in queue:
            for w, c in cap.get(v, {}).items():
                if c > 0 and w not in before:
                    before[w] = v
                    queue.append(w)
        if t not in before:
            return total
        v = t
        while v != s:
            cap[before[v]][v] -= 1
            cap[v][before[v]] = cap[v].get(before[v], 0) + 1
            v = before[v]
        total += 1


def _spread_flow(edges: DataFrame, s: int, t: int) -> int:
    """The same flow for a graph of any size: every augmenting path is a BFS in Spark. The driver holds the arcs in use, at most
    the lesser degree of s and t times the longest path."""
    both = cut(edges.unionByName(reverse(edges)).distinct())
    spark, used, total = edges.sparkSession, {}, 0
    while True:
        full = [k for k, v in used.items() if v > 0]
        free = both.join(F.broadcast(spark.createDataFrame(full, "src long, dst long")), ["src", "dst"], "left_anti") if full else both
        seen = cut(spark.createDataFrame([(s, None)], "node long, parent long"))
        frontier, found = seen, False
        while not found and not frontier.isEmpty():
            nxt = frontier.join(free, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("at")).agg(F.min("src").alias("parent"))
            frontier = cut(nxt.join(seen.select(F.col("node").alias("at")), "at", "left_anti").select(F.col("at").alias("node"), "parent"))
            seen = cut(seen.unionByName(frontier))
            found = not frontier.filter(F.col("node") == t).isEmpty()
        if not found:
            return total
        v = t
        while v != s:
            w = seen.filter(F.col("node") == v).first()["parent"]
            used[w, v], used[v, w] = used.get((w, v), 0) + 1, used.get((v, w), 0) - 1
            v = w
        total += 1


def min_cuts(edges: DataFrame, labels: DataFrame, *, most: int = 200_000) -> DataFrame:
    """(a, b, cross, cut, thinness): for every pair of clusters with edges between, the least edge cut between the two nodes
    of greatest degree, in the undirected graph of both clusters. Pairs up to `most` edges are solved in a task each, larger
    ones one after the other by Spark."""
    x, y = labels.select(F.col("id").alias("src"), F.col("cluster").alias("ca")), labels.select(F.col("id").alias("dst"), F.col("cluster").alias("cb"))
    u = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct().join(x, "src").join(y, "dst"))
    cross = u.filter("ca <> cb").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.count(F.lit(1)).alias("cross"))
    inner = u.filter("ca = cb")
    size = inner.groupBy(F.col("ca").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    ok = cross.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a", "left").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b", "left").withColumn("size", F.coalesce("na", F.lit(0)) + F.coalesce("nb", F.lit(0)) + F.col("cross"))
    ok = cut(ok.select("a", "b", "size"))
    large, ok = ok.filter(F.col("size") > most).select("a", "b").orderBy("a", "b").collect(), ok.filter(F.col("size") <= most).select("a", "b")  # pairs of clusters of over `most` edges
    mine = u.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "src", "dst", "ca", "cb").join(ok, ["a", "b"])
    mine = mine.unionByName(inner.join(ok, inner["ca"] == ok["a"]).select("a", "b", "src", "dst", "ca", "cb")).unionByName(inner.join(ok, inner["ca"] == ok["b"]).select("a", "b", "src", "dst", "ca", "cb"))

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        deg: dict[tuple[int, int], int] = {}
        for v, c in [*zip(d["src"], d["ca"], strict=True), *zip(d["dst"], d["cb"], strict=True)]:
            deg[c, v] = deg.get((c, v), 0) + 1
        ends = [min((v for (c, v) in deg if c == k), key=lambda v: (-deg[k, v], v)) for k in key]
        return pd.DataFrame([(*key, _flow(list(zip(d["src"], d["dst"], strict=True)), *ends))], columns=["a", "b", "cut"])

    cuts = mine.groupBy("a", "b").applyInPandas(run, "a long, b long, cut long")
    solved = []
    for a, b in large:
        own = cut(u.filter(F.col("ca").isin(a, b) & F.col("cb").isin(a, b)))
        ends = own.select(F.explode(F.array(F.struct("ca", F.col("src").alias("v")), F.struct(F.col("cb").alias("ca"), F.col("dst").alias("v")))).alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("k"))
        top = {r["c"]: -r["t"]["v"] for r in ends.groupBy(F.col("e.ca").alias("c")).agg(F.max(F.struct("k", (-F.col("e.v")).alias("v"))).alias("t")).collect()}
        solved.append((a, b, _spread_flow(own.select("src", "dst"), top[a], top[b])))
    if solved:
        cuts = cuts.unionByName(edges.sparkSession.createDataFrame(solved, "a long, b long, cut long"))
    return cross.join(cuts, ["a", "b"], "left").withColumn("thinness", F.col("cut") / F.col("cross"))


def safe_zone(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, boundary): nodes within `depth` forward or backward of start (id); boundary if a neighbour lies outside."""
    edges = cut(edges.select("src", "dst"))
    seeds = start.select(F.col("id").alias("node"))
    zone = cut(reach(edges, seeds, depth).select("node").union(reach(reverse(edges), seeds, depth).select("node")).distinct().select(F.col("node").alias("id")))
    both = edges.unionByName(reverse(edges))
    out = both.join(zone.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("src").alias("id")).distinct().withColumn("o", F.lit(1))
    return zone.join(out, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("boundary"))


def distance_matrix(edges: DataFrame, nodes: DataFrame, hops: int = 8) -> DataFrame:
    """(a, b, dist) between the given nodes (id), where reachable within `hops`."""
    d = bfs(edges, nodes.select(F.col("id").alias("root"), F.col("id").alias("node")), hops)
    return d.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").filter("dist > 0").select(F.col("root").alias("a"), F.col("node").alias("b"), "dist")


def set_cover(cover: DataFrame, most: int = 20) -> list[tuple[int, int]]:
    """Greedy set cover of (path_id, node): up to `most` (node, newly covered paths); a driver loop over one-row results."""
    left, out = cut(cover.select("path_id", "node").distinct()), []
    while len(out) < most:
        best = left.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "node").first()
        if best is None:
            break
        out.append((best["node"], best["n"]))
        left = cut(left.join(left.filter(F.col("node") == best["node"]).select("path_id"), "path_id", "left_anti"))
    return out


def propagation_cost(pairs: DataFrame, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n > 1, F.count(F.lit(1)) / (n * (n - 1))).otherwise(0.0)
