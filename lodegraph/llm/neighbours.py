"""Approximate nearest neighbours: stable low-dimensional projections, kd-trees and a chi-square stopping test.

Rows are dealt to buckets of norms (factors of two of the squared norm). In a bucket of largest norm M, largest inner products
become least distances by one more coordinate, sqrt(M^2 - |x|^2) for rows and 0 for queries. M_DIMS Gaussian (2-stable)
projections keep distances in law: |projected|^2 / distance^2 is chi-square with M_DIMS degrees of freedom. A query goes through
a kd-tree's leaves, and their rows, by projected distance and verifies them in the original space, until the stopping test
holds: a row still unverified would, were it as near as the k-th found, have projected so far with a probability below
1 - CONFIDENCE: radius^2 > chi-square quantile * (k-th distance)^2. Expected recall is CONFIDENCE or more. On clustered
vectors the test stops early; on vectors without structure (all distances alike) it must verify about half of all rows.

1. Equal vectors are one entry with their k + 1 smallest ids (more can't be in a result), so copies of any number cost one.
2. The top of a bucket's kd-tree, split at medians of a bounded sample of projections (SAMPLE entries of smallest hash), deals
   its entries to cells; a cell of more than CELL entries is cut into parts by hash, so no task holds more.
3. A query first searches the part of its own entry; the k-th score found there rules out, by the test, whole cells by their
   bounding boxes. The others are searched in (part, query chunk) groups of bounded size; what falls behind the k-th score of
   the first search isn't returned. A query set against all rows in blocks.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null id, take no part. Only vectors of one
length compare: a query of another length than a row never meets it. Repeated rows of an id count once. Ties go to the smaller
id. Scores are inner products in double precision of the vectors as given. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, staged, table

M_DIMS = 8
CONFIDENCE = 0.93
CELL = 8192
MOST_CELLS = 4096
MOST_BUCKETS = 20
LEAF = 64
SAMPLE = 65_536
CHUNK = 2048


def chi_square_point(p: float, m: int) -> float:
    """x with P(chi-square with m degrees, m even, <= x) = p, by bisection."""

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - float(np.exp(-x / 2)) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projector(dims: int, m: int = M_DIMS, seed: int = 77) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims + 1, m))


def split_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete kd-tree of 2^depth cells in heap order: (dimension of largest spread, median) of each inner node."""
    tree, groups = [], [points]
    for _ in range(depth):
        below = []
        for g in groups:
            d = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            cut = float(np.median(g[:, d])) if len(g) else 0.0
            tree.append((d, cut))
            below += [g[g[:, d] <= cut], g[g[:, d] > cut]] if len(g) else [g, g]
        groups = below
    return tree


def cells_of(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), dtype=np.int64)
    if tree:
        dim, cut = np.array([t[0] for t in tree]), np.array([t[1] for t in tree])
        while at.size and at[0] < len(tree):
            at = 2 * at + 1 + (points[np.arange(len(points)), dim[at]] > cut[at])
    return at - len(tree)


def leaves(points: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Row numbers of a kd-tree's leaves, halved by rank so that equal coordinates can't unbalance it."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        d = int(np.argmax(np.ptp(points[rows], axis=0)))
        rows = rows[np.argsort(points[rows, d], kind="stable")]
        todo += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return out


def search(x: np.ndarray, px: np.ndarray, ids: np.ndarray, q: np.ndarray, pq: np.ndarray, norm2: float, k: int, floor: np.ndarray, point: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query (row numbers of x, scores) of its k best, ties to smaller ids; and how many rows were verified in all.
    `floor`: a score that each query has k entries of already; rows below it aren't returned."""
    parts = leaves(px)
    lo, hi = np.array([px[r].min(0) for r in parts]), np.array([px[r].max(0) for r in parts])
    order = np.concatenate(parts)
    xs, ps, sizes = x[order], px[order], np.array([len(r) for r in parts])
    start = np.r_[0, np.cumsum(sizes)]
    out, verified = [], 0
    for i in range(len(q)):
        gap = ((np.maximum(lo - pq[i], 0) + np.maximum(pq[i] - hi, 0)) ** 2).sum(1)
        by = np.argsort(gap, kind="stable")
        size2 = float(q[i] @ q[i])
        base, slack = size2 + norm2, 1e-12 * np.sqrt(size2 * norm2)
        rows, score, at, step, kth = np.zeros(0, np.int64), np.zeros(0), 0, 2, float(floor[i])
        reach = lambda s: point * max(0.0, base - 2 * (s - slack))  # noqa: E731  squared radius that the test still asks for
        while at < len(by) and gap[by[at]] <= reach(kth):
            some = by[at : at + step]
            near = np.concatenate([np.arange(start[s], start[s + 1]) for s in some])
            near = near[((ps[near] - pq[i]) ** 2).sum(1) <= reach(kth)]
            verified += len(near)
            rows, score = np.r_[rows, near], np.r_[score, xs[near] @ q[i]]
            if len(score) > k:
                kth = max(kth, float(np.partition(score, len(score) - k)[len(score) - k]))
            keep = score >= kth - slack
            rows, score = rows[keep], score[keep]
            at += step
            step = min(2 * step, 32)
        rows = order[rows]
        exact = (x[rows] * q[i]).sum(1)
        top = np.lexsort((ids[rows], -exact))[:k]
        out.append((rows[top], exact[top]))
    return out, verified


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k nearest found among the others."""
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    v = v.filter(fine).withColumn("v", F.transform("v", lambda e: e + F.lit(0.0).cast(kind[6:-1])))  # -0.0 becomes 0.0
    v = v.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v"))
    few = v.withColumn("n", F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    size2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    entries = few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("first", F.element_at("ids", 1))
    entries = staged(entries.withColumn("e", F.monotonically_increasing_id()).withColumn("dims", F.size("v")).withColumn("size2", size2), "entries")
    queries = v.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    queries = staged(queries.join(entries.select("h1", "h2", "e"), ["h1", "h2"]).select("query_id", "e"), "queries")
    tops = {r["dims"]: r["top"] for r in entries.groupBy("dims").agg(F.max("size2").alias("top")).collect()}  # one row a vector length
    most = F.create_map(*[F.lit(x) for pair in tops.items() for x in pair])[F.col("dims")] if tops else F.lit(1.0)
    bucketed = entries.withColumn("bucket", F.least(F.floor(F.log2(most / F.col("size2"))), F.lit(MOST_BUCKETS)).cast("int"))
    facts = bucketed.groupBy("dims", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("size2").alias("norm2")).collect()  # MOST_BUCKETS + 1 a length at most
    facts = {(r["dims"], r["bucket"]): (r["n"], r["norm2"] * (1 + 1e-12)) for r in facts}
    point = chi_square_point(confidence, M_DIMS)

    def projected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": [p for d, u, x in zip(b["dims"], b["bucket"], b["v"], strict=True) for p in _projected(np.array([x], dtype=np.float64), facts[d, u][1])]})

    trees = {}
    for (dims, bucket), (n, _) in facts.items():
        depth = max(0, int(np.ceil(np.log2(min(MOST_CELLS, max(1.0, n / CELL))))))
        own = bucketed.filter((F.col("dims") == dims) & (F.col("bucket") == bucket))
        sample = own.orderBy("h1", "h2").limit(SAMPLE).select("dims", "bucket", "v").mapInPandas(projected, "p array<double>").toPandas() if depth else None  # SAMPLE rows of M_DIMS numbers
        trees[dims, bucket] = split_tree(_matrix(sample["p"]), depth) if depth else []

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, boxes = np.zeros(len(b), np.int64), np.empty(len(b), object)
            for (d, u), own in b.reset_index(drop=True).groupby(["dims", "bucket"]):
                at = own.index.to_numpy()
                p = _projected(_matrix(own["v"]), facts[d, u][1])
                cell[at] = cells_of(p, trees[d, u])
                boxes[at] = list(p.astype(np.float32).astype(np.float64))
            yield pd.DataFrame({"e": b["e"], "v": b["v"], "first": b["first"], "dims": b["dims"], "bucket": b["bucket"], "cell": cell, "p": boxes})

    schema = f"e long, v {kind}, first long, dims int, bucket int, cell long, p array<float>"
    points = staged(bucketed.select("e", "v", "first", "dims", "bucket").mapInPandas(deal, schema), "points")
    c = ["dims", "bucket", "cell"]
    parts = staged(points.groupBy(*c).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts")), "parts")
    points = points.join(F.broadcast(parts), c).withColumn("part", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int"))  # MOST_CELLS rows a bucket at most
    g = [*c, "part"]
    asked = points.join(queries.select("e").distinct(), "e", "left_semi")
    # a query's own projection has 0 as last coordinate, so it is made anew; its home is the part of its entry
    home = staged(asked.select(F.col("e").alias("q"), F.col("v").alias("qv"), *g, F.lit(float("-inf")).alias("floor")), "home")
    found = "q long, e long, score double, kth double"

    def visit(_key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame(columns=["q", "e", "score", "kth"])
        norm2 = facts[int(rows["dims"].iloc[0]), int(rows["bucket"].iloc[0])][1]
        q, names = _matrix(asks["qv"]), rows["e"].to_numpy()
        hits, _ = search(_matrix(rows["v"]), _matrix(rows["p"]), rows["first"].to_numpy(), q, _projected_query(q), norm2, k + 1, asks["floor"].to_numpy(), point)
        out = [pd.DataFrame({"q": asks["q"].iloc[i], "e": names[at], "score": score, "kth": score[-1] if len(score) > k else -np.inf}) for i, (at, score) in enumerate(hits)]
        return pd.concat(out)

    def chunked(asks: DataFrame) -> DataFrame:
        """Results of (query, part) rows: chunks of about CHUNK queries, each with a copy of its part's rows."""
        counts = staged(asks.groupBy(*g).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "chunks")
        a = asks.join(counts, g).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks")).cast("int")).drop("chunks")
        r = points.drop("parts").join(counts, g).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        by = [*g, "chunk"]
        return staged(r.groupBy(*by).cogroup(a.groupBy(*by)).applyInPandas(visit, found), "found")

    near = chunked(home)
    boxes = points.select(*g, F.posexplode("p").alias("i", "x")).groupBy(*g, "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    boxes = boxes.groupBy(*c).agg(F.max("part").alias("part"), *[F.min(F.when(F.col("i") == i, F.col("lo"))).alias(f"lo{i}") for i in range(M_DIMS)], *[F.max(F.when(F.col("i") == i, F.col("hi"))).alias(f"hi{i}") for i in range(M_DIMS)])
    boxes = boxes.orderBy(*c).collect()  # MOST_CELLS rows a bucket at most
    cells = {d: [r for r in boxes if r["dims"] == d] for d in tops}
    los = {d: np.array([[r[f"lo{i}"] for i in range(M_DIMS)] for r in rs], dtype=np.float64) for d, rs in cells.items()}
    his = {d: np.array([[r[f"hi{i}"] for i in range(M_DIMS)] for r in rs], dtype=np.float64) for d, rs in cells.items()}
    norms = {d: np.array([facts[d, r["bucket"]][1] for r in rs]) for d, rs in cells.items()}
    places = {d: [(r["bucket"], r["cell"], r["part"]) for r in rs] for d, rs in cells.items()}

    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                out = []
                for q, qv, d, u, cell, part, kth in b.iloc[at : at + 1000][["q", "qv", *g, "kth"]].itertuples(index=False):
                    x = np.array([qv], dtype=np.float64)
                    pq = _projected_query(x)[0]
                    gap = ((np.maximum(los[d] - pq, 0) + np.maximum(pq - his[d], 0)) ** 2).sum(1)
                    size2 = float(x[0] @ x[0])
                    dist2 = size2 + norms[d] - 2 * (kth - 1e-12 * np.sqrt(size2 * norms[d]))
                    for j in np.flatnonzero((gap <= point * np.maximum(dist2, 0)) & (dist2 >= 0)).tolist():
                        w, cc, last = places[d][j]
                        out += [(q, qv, d, w, cc, n, kth) for n in range(last + 1) if (w, cc, n) != (u, cell, part)]
                yield pd.DataFrame(out, columns=["q", "qv", *g, "floor"])

    kths = near.groupBy("q").agg(F.max("kth").alias("kth"))
    asks = home.drop("floor").join(kths, "q", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    asks = staged(asks.mapInPandas(further, f"q long, qv {kind}, dims int, bucket int, cell long, part int, floor double"), "asks")
    every_hit = staged(near.union(chunked(asks)).select("q", "e", "score").join(entries.select("e", "first"), "e"), "hits")
    hits = every_hit.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first"))).filter(F.col("n") <= k + 1)
    hits = hits.select("q", "e", "score").join(entries.select("e", "ids"), "e").select("q", "score", F.explode("ids").alias("vec_id"))
    discard(near, home, asks)
    pairs = queries.join(hits, F.col("e") == F.col("q")).filter(F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", "score").distinct()
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _projected(x: np.ndarray, norm2: float) -> np.ndarray:
    last = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
    return np.c_[x, last] @ projector(x.shape[1])


def _projected_query(q: np.ndarray) -> np.ndarray:
    return q @ projector(q.shape[1])[:-1]


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20, against all others."""
    return nearest(table(spark, sf_dir, "embeddings"))
