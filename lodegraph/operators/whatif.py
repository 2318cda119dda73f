"""What-if transforms and comparisons of graphs and symbol tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def move(symbols: DataFrame, moves: DataFrame) -> DataFrame:
    """Symbols with new files from (id, to_file)."""
    return symbols.join(moves, "id", "left").withColumn("file_id", F.coalesce("to_file", "file_id")).drop("to_file")


def merge(files_of: DataFrame, a: int, b: int) -> DataFrame:
    """Symbols with file `b` folded into `a`."""
    return files_of.withColumn("file_id", F.when(F.col("file_id") == b, F.lit(a)).otherwise(F.col("file_id")))


def delete(symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the symbols `gone` (id) and edges at them."""
    e = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return symbols.join(gone, "id", "left_anti"), e


def file_graph(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, symbol_count) between files."""
    a, b = symbols.select(F.col("id").alias("src"), F.col("file_id").alias("fa")), symbols.select(F.col("id").alias("dst"), F.col("file_id").alias("fb"))
    return edges.join(a, "src").join(b, "dst").filter("fa <> fb").groupBy(F.col("fa").alias("src"), F.col("fb").alias("dst")).agg(F.count(F.lit(1)).alias("symbol_count"))


def graph_metrics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes and highest in-degree."""
    d = edges.select("src", "dst").distinct()
    i = d.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_in"))
    used = d.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lone = vertices.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    return vertices.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(d.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(lone).crossJoin(i)  # one row each


def symbol_diff(old: DataFrame, new: DataFrame, key: str, *compared: str) -> DataFrame:
    """(key, status) of symbols added, removed or modified between two tables."""
    a = old.select(key, F.struct(*compared).alias("o"))
    b = new.select(key, F.struct(*compared).alias("n"))
    d = a.join(b, key, "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "modified")
    return d.select(key, status.alias("status")).filter(F.col("status").isNotNull())


def incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of files added, removed or modified: equal times within a millisecond mean unchanged, else hashes decide."""
    d = old.select("path", F.col("mtime").alias("ot"), F.col("hash").alias("oh")).join(new.select("path", F.col("mtime").alias("nt"), F.col("hash").alias("nh")), "path", "full")
    same = (F.abs(F.col("ot") - F.col("nt")) <= 0.001) | (F.col("oh") == F.col("nh"))
    status = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "removed").when(~same, "modified")
    return d.select("path", status.alias("status")).filter(F.col("status").isNotNull())


def edge_analysis(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, edges) counts of edges added, removed and kept."""
    a, b = old.select("src", "dst", F.lit(1).alias("o")).distinct(), new.select("src", "dst", F.lit(1).alias("n")).distinct()
    d = a.join(b, ["src", "dst"], "full")
    return d.groupBy(F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("status")).agg(F.count(F.lit(1)).alias("edges"))


def footprint(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: changed symbols, direct dependents and dependencies outside the change."""
    c = changed.select("id").distinct()
    up = edges.join(c.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(c, "id", "left_anti").agg(F.count(F.lit(1)).alias("dependents"))
    down = edges.join(c.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(c, "id", "left_anti").agg(F.count(F.lit(1)).alias("dependencies"))
    return c.agg(F.count(F.lit(1)).alias("changed")).crossJoin(up).crossJoin(down)  # one row each


def adversarial(edges: DataFrame, layers: DataFrame, labels: DataFrame, symbols: DataFrame, fan: int = 10) -> DataFrame:
    """(check, id, other, detail): layer skips, cross-cluster edges by unordered pair (id, other), exported orphans, large fan-out."""
    la, lb = layers.select(F.col("id").alias("src"), F.col("layer").alias("a")), layers.select(F.col("id").alias("dst"), F.col("layer").alias("b"))
    skip = edges.join(la, "src").join(lb, "dst").filter("abs(b - a) > 1").select(F.lit("layer-skip").alias("check"), F.col("src").alias("id"), F.abs(F.col("b") - F.col("a")).alias("detail"))
    ca, cb = labels.select(F.col("id").alias("src"), F.col("cluster").alias("a")), labels.select(F.col("id").alias("dst"), F.col("cluster").alias("b"))
    cross = edges.join(ca, "src").join(cb, "dst").filter("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cross = cross.select(F.lit("cross-cluster").alias("check"), F.col("x").alias("id"), F.col("n").alias("detail"), F.col("y").alias("other"))
    orphan = symbols.filter("is_exported = 1 AND kind <> 'interface'").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select(F.lit("orphan").alias("check"), "id", F.lit(0).cast("long").alias("detail"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("detail")).filter(F.col("detail") > fan).select(F.lit("fan-out").alias("check"), "id", "detail")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (cross, skip, orphan, out)).select("check", "id", "other", "detail")
