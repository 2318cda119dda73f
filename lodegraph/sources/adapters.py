"""The abstract code-graph schema as views over the driver's star-schema tables, as DataFrames and as SQL for oracles.

orders are commits, line items file changes, parts are files (history grain) or symbols (ten to a file, code grain), events are
spans, events per day and type are metric series.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Views of one data folder. Nothing is read before an action."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def commits(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("author"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("message"))

    @cached_property
    def changes(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file_id"), F.col("l_quantity").cast("long").alias("lines_added"), F.round(F.col("l_tax") * 100).cast("long").alias("lines_removed"))

    @cached_property
    def coarse(self) -> DataFrame:
        li = self.raw("lineitem")
        return li.select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("file_id"), F.col("l_quantity").cast("long").alias("lines_added"))

    @cached_property
    def paths(self) -> DataFrame:
        p = self.raw("part")
        d = F.concat_ws("/", F.lower("p_type"), F.lower("p_brand"))
        path = F.concat(d, F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey"), F.lit(".py"))
        return p.select(F.col("p_partkey").alias("id"), path.alias("path"), d.alias("dir"), F.col("p_brand").alias("language"), F.col("p_size").cast("long").alias("line_count"))

    @cached_property
    def symbols(self) -> DataFrame:
        p = self.raw("part")
        k, s = F.col("p_partkey"), F.col("p_size")
        kind = F.element_at(F.array(*map(F.lit, ("function", "class", "method", "interface"))), (s % 4 + 1).cast("int"))
        base = F.regexp_replace("p_name", " ", "_")
        name = F.when(s % 4 == 1, F.regexp_replace(F.initcap("p_name"), " ", "")).when(k % 7 == 0, F.concat(F.lit("get_"), base)).when(k % 7 == 1, F.concat(F.lit("sort_"), base)).otherwise(F.concat(F.element_at(F.array(*map(F.lit, PREFIXES)), (k % 15 + 1).cast("int")), base))
        return p.select(
            k.alias("id"), F.expr("p_partkey div 10").alias("file_id"), name.alias("name"), F.concat(F.lower("p_brand"), F.lit("."), name).alias("qualified"), kind.alias("kind"),
            (k % 10 * 50 + 1).alias("line_start"), (k % 10 * 50 + 10 + s).alias("line_end"), (s % 3 != 0).cast("int").alias("is_exported"), F.when(k % 5 != 0, k - k % 5).alias("parent_id"),
        )

    @cached_property
    def files(self) -> DataFrame:
        f = F.col("id")
        d = F.concat(F.lit("src/m"), f % 7)
        return self.raw("part").select(F.expr("p_partkey div 10").alias("id")).distinct().select("id", F.concat(F.when(f % 11 == 0, F.lit("tests/test_f")).otherwise(F.concat(d, F.lit("/f"))), f, F.lit(".py")).alias("path"), F.when(f % 11 == 0, F.lit("tests")).otherwise(d).alias("dir"), (f % 11 == 0).cast("int").alias("is_test"))

    @cached_property
    def edges(self) -> DataFrame:
        li = self.raw("lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_discount") <= 0.03)).select("l_orderkey", "l_partkey", "l_shipdate", "l_linestatus")
        a = li.select("l_orderkey", F.col("l_partkey").alias("src"), F.col("l_shipdate").alias("da"))
        b = li.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_shipdate").alias("db"), F.when(F.col("l_linestatus") == "O", "call").otherwise("import").alias("kind"))
        return a.join(b, "l_orderkey").filter((F.col("da") < F.col("db")) & (F.col("src") != F.col("dst"))).select("src", "dst", "kind").distinct()

    @cached_property
    def graph(self) -> DataFrame:
        return self.edges.select("src", "dst").distinct()

    @cached_property
    def file_edges(self) -> DataFrame:
        e = self.edges.select(F.expr("src div 10").alias("src"), F.expr("dst div 10").alias("dst")).filter("src <> dst")
        return e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("symbol_count"))

    @cached_property
    def metrics(self) -> DataFrame:
        p = self.raw("part")
        k, s = F.col("p_partkey"), F.col("p_size").cast("long")
        return p.select(k.alias("symbol_id"), s.alias("cc"), (s % 7).alias("nesting"), (k % 6).alias("params"), (s * 3).alias("line_count"), (k % 4).alias("returns"), (k % 9).alias("bool_ops"))

    @cached_property
    def signals(self) -> DataFrame:
        p = self.raw("part")
        k, s = F.col("p_partkey"), F.col("p_size")
        bit = lambda n, r: (k % n == r).cast("int")
        calls = F.filter(F.array(*[F.when(k % n == r, F.lit(w)) for n, r, w in CALLS]), lambda c: c.isNotNull())
        return p.select(
            k.alias("symbol_id"), (s % 4).cast("long").alias("loop_depth"), (s % 4 >= 2).cast("int").alias("nested"), calls.alias("calls"), bit(3, 0).alias("subscript"), bit(13, 1).alias("self_call"), (k % 13 == 1).cast("long").alias("self_calls_base"),
            bit(4, 1).alias("compares"), bit(5, 2).alias("accumulates"), bit(6, 1).alias("concat"), bit(8, 3).alias("bounded"), (F.when(k % 13 == 1, k % 4).otherwise(0)).cast("long").alias("self_calls"),
            F.filter(F.array(*[F.when(k % n == r, F.lit(w)) for n, r, w in INVARIANT]), lambda c: c.isNotNull()).alias("invariant"),
        ).drop("self_calls_base")

    @cached_property
    def labels(self) -> DataFrame:
        """A given clustering of symbols."""
        return self.raw("part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 12).alias("cluster"))

    @cached_property
    def spans(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_id").alias("span_id"), F.concat(F.lit("op_"), F.col("user_id") % 40).alias("name"), F.col("value").alias("ms"), (F.col("event_type") == "error").cast("int").alias("error"), F.unix_timestamp("ts").alias("ts"), "event_type")

    @cached_property
    def series(self) -> DataFrame:
        """(series, idx, value): events per day of each type, days in order from 0."""
        e = self.raw("events").groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return e.select("series", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("idx"), "value")


#: What further names start with, by p_partkey % 15: plain names and such as detectors look for.
PREFIXES = ("", "fib_", "linear_search_", "", "contains_", "group_by_", "", "unique_", "find_max_", "", "sum_", "has_", "", "dedup_", "partition_")
_PREFIX = "[" + ", ".join(f"'{x}'" for x in PREFIXES) + "][p_partkey % 15 + 1]"
CALLS = [(10, 1, "sleep"), (9, 2, "sort"), (8, 5, "compile"), (7, 3, "query"), (11, 4, "insert"), (12, 7, "index"), (14, 9, "match"), (15, 2, "add")]
INVARIANT = [(16, 3, "len"), (17, 5, "load_config"), (18, 1, "now")]


def _list(items: list[tuple[int, int, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN p_partkey % {n} = {r} THEN '{w}' END" for n, r, w in items) + "], lambda x: x IS NOT NULL)"


#: The same views for DuckDB.
VIEWS = {
    "commits": "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS author, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_orderpriority AS message FROM orders",
    "changes": "SELECT l_orderkey AS commit_id, l_partkey AS file_id, CAST(l_quantity AS BIGINT) AS lines_added, CAST(round(l_tax * 100) AS BIGINT) AS lines_removed FROM lineitem",
    "coarse": "SELECT l_orderkey AS commit_id, l_suppkey AS file_id, CAST(l_quantity AS BIGINT) AS lines_added FROM lineitem",
    "paths": "SELECT p_partkey AS id, lower(p_type) || '/' || lower(p_brand) || '/' || replace(p_name, ' ', '_') || '_' || p_partkey || '.py' AS path, lower(p_type) || '/' || lower(p_brand) AS dir, p_brand AS language, CAST(p_size AS BIGINT) AS line_count FROM part",
    "named": "SELECT *, replace(p_name, ' ', '_') AS base, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', '') AS pascal FROM part",
    "symbols": "SELECT p_partkey AS id, p_partkey // 10 AS file_id, CASE WHEN p_size % 4 = 1 THEN pascal WHEN p_partkey % 7 = 0 THEN 'get_' || base WHEN p_partkey % 7 = 1 THEN 'sort_' || base ELSE " + _PREFIX + " || base END AS name, "
    "lower(p_brand) || '.' || CASE WHEN p_size % 4 = 1 THEN pascal WHEN p_partkey % 7 = 0 THEN 'get_' || base WHEN p_partkey % 7 = 1 THEN 'sort_' || base ELSE " + _PREFIX + " || base END AS qualified, "
    "['function', 'class', 'method', 'interface'][p_size % 4 + 1] AS kind, p_partkey % 10 * 50 + 1 AS line_start, p_partkey % 10 * 50 + 10 + p_size AS line_end, CAST(p_size % 3 <> 0 AS INTEGER) AS is_exported, "
    "CASE WHEN p_partkey % 5 <> 0 THEN p_partkey - p_partkey % 5 END AS parent_id FROM named",
    "files": "SELECT id, CASE WHEN id % 11 = 0 THEN 'tests/test_f' ELSE 'src/m' || (id % 7) || '/f' END || id || '.py' AS path, CASE WHEN id % 11 = 0 THEN 'tests' ELSE 'src/m' || (id % 7) END AS dir, CAST(id % 11 = 0 AS INTEGER) AS is_test FROM (SELECT DISTINCT p_partkey // 10 AS id FROM part)",
    "edges": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, CASE WHEN b.l_linestatus = 'O' THEN 'call' ELSE 'import' END AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_shipdate < b.l_shipdate AND a.l_partkey <> b.l_partkey "
    "WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND a.l_discount <= 0.03 AND b.l_discount <= 0.03",
    "graph": "SELECT DISTINCT src, dst FROM edges",
    "file_edges": "SELECT src // 10 AS src, dst // 10 AS dst, count(*) AS symbol_count FROM edges WHERE src // 10 <> dst // 10 GROUP BY 1, 2",
    "metrics": "SELECT p_partkey AS symbol_id, CAST(p_size AS BIGINT) AS cc, CAST(p_size % 7 AS BIGINT) AS nesting, p_partkey % 6 AS params, CAST(p_size * 3 AS BIGINT) AS line_count, p_partkey % 4 AS returns, p_partkey % 9 AS bool_ops FROM part",
    "signals": "SELECT p_partkey AS symbol_id, p_size % 4 AS loop_depth, CAST(p_size % 4 >= 2 AS INTEGER) AS nested, " + _list(CALLS) + " AS calls, CAST(p_partkey % 3 = 0 AS INTEGER) AS subscript, CAST(p_partkey % 13 = 1 AS INTEGER) AS self_call, "
    "CAST(p_partkey % 4 = 1 AS INTEGER) AS compares, CAST(p_partkey % 5 = 2 AS INTEGER) AS accumulates, CAST(p_partkey % 6 = 1 AS INTEGER) AS concat, CAST(p_partkey % 8 = 3 AS INTEGER) AS bounded, CASE WHEN p_partkey % 13 = 1 THEN p_partkey % 4 ELSE 0 END AS self_calls, " + _list(INVARIANT) + " AS invariant FROM part",
    "labelled": "SELECT p_partkey AS id, p_partkey % 12 AS cluster FROM part",
    "spans": "SELECT event_id AS span_id, 'op_' || (user_id % 40) AS name, value AS ms, CAST(event_type = 'error' AS INTEGER) AS error, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type FROM events",
    "series": "SELECT event_type AS series, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS idx, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
}
NEEDS = {"symbols": ["named"], "graph": ["edges"], "file_edges": ["edges"]}


def oracle(body: str, recursive: bool = False) -> str:
    """`body` after the views that it names; further WITH parts may follow in `body`, which then starts with a comma."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in NEEDS.get(name, []):
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            need(name)
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    if not views and body.lstrip().startswith(","):
        body = body.lstrip()[1:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{body}" if views or recursive or body.lstrip()[:1] != "S" else body
