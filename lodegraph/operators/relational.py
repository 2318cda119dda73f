"""Named relational queries over symbols, files and edges. Every function is a declarative plan without actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def degrees(vertices: DataFrame, graph: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over distinct edges; vertices without edges have 0."""
    i = graph.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = graph.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return vertices.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0, ["in_degree", "out_degree"])


def search_symbols(symbols: DataFrame, degree: DataFrame, pattern: str, k: int) -> DataFrame:
    """Case-insensitive name search ranked by a measure, then name and id."""
    d = symbols.filter(F.col("name").ilike(pattern)).join(degree, "id", "left")
    return d.orderBy(F.coalesce("in_degree", F.lit(0)).desc(), "name", "id").limit(k)


def neighbours(edges: DataFrame, symbols: DataFrame, files: DataFrame, *, of: Column, callers: bool) -> DataFrame:
    """Callers (or callees) of the symbols that `of` selects on (src, dst)."""
    other = "src" if callers else "dst"
    d = edges.filter(of).join(symbols.select(F.col("id").alias(other), "name", "file_id"), other).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return d.select(F.col("dst" if callers else "src").alias("symbol_id"), F.col(other).alias("neighbour_id"), "name", "path", "kind")


def file_links(file_edges: DataFrame, files: DataFrame, *, imported_by: bool) -> DataFrame:
    """Per file: files linked to it, total of symbol counts."""
    at, other = ("dst", "src") if imported_by else ("src", "dst")
    d = file_edges.groupBy(F.col(at).alias("id")).agg(F.count_distinct(other).alias("files"), F.sum("symbol_count").alias("symbols"))
    return d.join(files.select("id", "path"), "id")


def unreferenced_exports(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return symbols.filter(F.col("is_exported") == 1).join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def clusters_summary(labels: DataFrame, symbols: DataFrame) -> DataFrame:
    """Size of each cluster and its names, sorted and joined."""
    return labels.join(symbols.select("id", "name"), "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For each (file_id, line) the smallest span (id, line_start, line_end) of the file that holds it; ties to the smaller id."""
    d = points.join(spans, "file_id").filter(F.col("line").between(F.col("line_start"), F.col("line_end")))
    w = Window.partitionBy("file_id", "line").orderBy(F.col("line_end") - F.col("line_start"), "id")
    return d.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def resolve(refs: DataFrame, symbols: DataFrame, degree: DataFrame) -> DataFrame:
    """For each `ref`: the symbol whose qualified name, else name, else lower-cased name equals it; of several the one with
    most incoming edges, then the smallest id."""
    s = symbols.select("id", "name", "qualified")
    keys = [(1, F.col("ref"), "qualified", F.col("qualified")), (2, F.col("ref"), "name", F.col("name")), (3, F.lower("ref"), "name", F.lower("name"))]
    found = None
    for p, left, _, right in keys:
        one = refs.withColumn("k", left).join(s.withColumn("k", right), "k").select("ref", "id", F.lit(p).alias("priority"))
        found = one if found is None else found.unionByName(one)
    found = found.join(degree.select("id", "in_degree"), "id", "left")
    w = Window.partitionBy("ref").orderBy("priority", F.coalesce("in_degree", F.lit(0)).desc(), "id")
    return found.withColumn("n", F.row_number().over(w)).filter("n = 1").select("ref", "id", "priority")


def mutual(edges: DataFrame) -> DataFrame:
    """Members of two-cycles."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("id")).distinct()


def entry_files(files: DataFrame, symbols: DataFrame, file_edges: DataFrame) -> DataFrame:
    """Files with symbols that no other file imports, by number of symbols."""
    n = symbols.groupBy(F.col("file_id").alias("id")).agg(F.count(F.lit(1)).alias("symbols"))
    return files.join(n, "id").join(file_edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").select("id", "path", "symbols")


def top(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def role(indeg: Column, outdeg: Column, reach: Column) -> Column:
    """Hub, core utility, orchestrator, utility, leaf or internal, by degrees."""
    return (
        F.when((indeg >= 3) & (outdeg >= 3), "hub")
        .when(indeg >= 4, "core_utility")
        .when(outdeg >= 4, "orchestrator")
        .when((indeg >= 2) & (outdeg == 0), "utility")
        .when((indeg == 0) & (outdeg == 0) & (reach == 0), "leaf")
        .otherwise("internal")
    )
