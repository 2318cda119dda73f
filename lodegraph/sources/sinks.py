"""Sinks: envelopes, SARIF, Mermaid, upserts and capsules. Rows are rendered in Spark; whole documents only of small frames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def envelope(command: str, summary: dict, rows: DataFrame, *, as_of: str, version: str = "1", limit: int = 10_000) -> str:
    """A command's JSON envelope with at most `limit` result rows (a report; `truncated` says so)."""
    found = [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct("*")).alias("j")).limit(limit + 1).collect()]
    return json.dumps({"schema": "lodegraph/envelope", "schema_version": version, "command": command, "timestamp": as_of, "summary": summary | {"truncated": len(found) > limit}, "results": found[:limit]}, sort_keys=True)


def sarif(violations: DataFrame, tool: str, level: str = "warning") -> DataFrame:
    """(rule, result): a SARIF 2.1.0 result object for each (rule, id, detail)."""
    r = F.struct(F.col("rule").alias("ruleId"), F.lit(level).alias("level"), F.struct(F.col("detail").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("id").cast("string").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    return violations.select("rule", F.to_json(r).alias("result"))


def sarif_document(results: list[str], tool: str) -> str:
    rules = sorted({json.loads(r)["ruleId"] for r in results})
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "results": [json.loads(r) for r in results]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, sort_keys=True)


def mermaid_lines(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(line) of a flow chart: one row for each edge, for subgraphs of any size."""
    a, b = names.select(F.col("id").alias("src"), F.col("name").alias("sn")), names.select(F.col("id").alias("dst"), F.col("name").alias("dn"))
    return edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").select(F.format_string('  n%d["%s"] --> n%d["%s"]', "src", "sn", "dst", "dn").alias("line"))


def tsv(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, of each key the one latest by `order`."""
    both = old.unionByName(new)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def redacted(path: Column) -> Column:
    """A path whose parts are hashed."""
    return F.array_join(F.transform(F.split(path, "/"), lambda p: F.substring(F.sha2(p, 256), 1, 12)), "/")


def evidence_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of all rows, whatever their order. Rows are hashed where they are; their hashes' sums are hashed."""
    h = df.select(F.sha2(F.to_json(F.struct("*")), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(5)]
    return h.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("hash"))
