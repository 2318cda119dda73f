"""Readers: change logs, blame, traces, vulnerability reports, file tables, source parsing. Each returns a DataFrame."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".vue": "vue", ".yml": "yaml", ".yaml": "yaml", ".tf": "hcl", ".cls": "apex", ".prg": "foxpro", ".md": "markdown", ".json": "json"}
_GENERATED = "(?i)(generated by|do not edit|auto-?generated|@generated)"


def language(path: Column) -> Column:
    """Language by extension; metadata XML of its own kind; null if unknown."""
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(path.endswith("-meta.xml"), "sfxml").otherwise(F.element_at(m, F.lower(F.regexp_extract(path, "\\.[^./]+$", 0))))


def file_role(path: Column, head: Column) -> Column:
    """generated (by content) > vendored > test > ci > build > docs > generated (by name) > config > script > source."""
    p = F.lower(path)
    return (
        F.when(F.coalesce(F.exists(F.slice(F.split(head, "\n"), 1, 10), lambda x: x.rlike(_GENERATED)), F.lit(False)), "generated")
        .when(p.rlike("(^|/)(vendor|third_party|node_modules)/"), "vendored")
        .when(p.rlike("(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*$|[._-](test|spec)\\.[^/]*$"), "test")
        .when(p.rlike("(^|/)(\\.github|\\.circleci|ci)/"), "ci")
        .when(p.rlike("(^|/)(makefile|dockerfile|build\\.gradle|pom\\.xml|package\\.json|cmakelists\\.txt|setup\\.py|pyproject\\.toml)$"), "build")
        .when(p.rlike("(^|/)docs?/|\\.(md|rst)$"), "docs")
        .when(p.rlike("\\.min\\.(js|css)$|_pb2\\.py$|\\.g\\.dart$"), "generated")
        .when(p.rlike("\\.(ya?ml|toml|ini|json|env)$"), "config")
        .when(F.coalesce(head, F.lit("")).startswith("#!"), "script")
        .otherwise("source")
    )


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, hash, language, line_count) of the files below `root`, read by Spark's binary source; excluded
    folders never reach Python."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    d = d.filter(~F.col("path").rlike("/(\\.git|node_modules|__pycache__|\\.venv|dist|build)/"))
    text = F.decode("content", "UTF-8")
    return d.select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").cast("double").alias("mtime"), F.sha2("content", 256).alias("hash"), language(F.col("path")).alias("language"), F.regexp_count(text, F.lit("\n")).cast("long").alias("line_count"), file_role(F.col("path"), F.substring(text, 1, 2000)).alias("role"))


def change_log(lines: DataFrame) -> DataFrame:
    """(hash, author, ts, message, path, added, removed) from numbered log lines (line, value): headers
    `COMMIT:hash|author|epoch|message`, then tab-separated counts; binary `-` is 0 and of a rename the new side stays.
    A log is one ordered stream, so its lines share one window; read several logs with a column of their own to partition by."""
    head = F.col("value").startswith("COMMIT:")
    keys = [c for c in lines.columns if c not in ("line", "value")]
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("h", F.last(F.when(head, F.substring("value", 8, 1 << 20)), ignorenulls=True).over(w)).filter(~head & F.col("value").contains("\t"))
    p, c = F.split("h", "\\|", 4), F.split("value", "\t", 3)
    num = lambda x: F.coalesce(x.try_cast("long"), F.lit(0))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(c[2], "\\{[^{}]* => ([^{}]*)\\}", "$1"), "^.* => ", ""), "//", "/")
    return d.select(*keys, p[0].alias("hash"), p[1].alias("author"), p[2].try_cast("long").alias("ts"), p[3].alias("message"), path.alias("path"), num(c[0]).alias("added"), num(c[1]).alias("removed"))


def blame(lines: DataFrame) -> DataFrame:
    """(hash, author, ts, body) of porcelain blame lines (line, value)."""
    w = Window.partitionBy(F.lit(0)).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda pat, k: F.last(F.when(F.col("value").rlike(pat), F.regexp_extract("value", pat, k)), ignorenulls=True).over(w)
    d = lines.select("line", "value", carry("^([0-9a-f]{40}) ", 1).alias("hash"), carry("^author (.*)$", 1).alias("author"), carry("^author-time ([0-9]+)$", 1).cast("long").alias("ts"))
    return d.filter(F.col("value").startswith("\t")).select("hash", "author", "ts", F.substring("value", 2, 1 << 20).alias("body"))


def sniff_trace(keys: list[str]) -> str:
    """Trace format by a report's top-level keys."""
    k = set(keys)
    return "otel" if "resourceSpans" in k else "jaeger" if "data" in k else "zipkin" if {"traceId", "duration"} <= k else "generic"


def _span_stats(d: DataFrame) -> DataFrame:
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("call_count"), F.percentile("ms", F.lit(0.5)).alias("p50_latency_ms"), F.percentile("ms", F.lit(0.99)).alias("p99_latency_ms"), F.avg(F.col("error").cast("int")).alias("error_rate"))


def otel(d: DataFrame) -> DataFrame:
    """Statistics by span name of OTLP JSON."""
    s = d.select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x"))
    ms = (F.col("x.endTimeUnixNano").cast("double") - F.col("x.startTimeUnixNano").cast("double")) / 1e6
    return _span_stats(s.select(F.col("x.name").alias("name"), ms.alias("ms"), (F.coalesce(F.col("x.status.code").cast("string"), F.lit("0")).isin("2", "STATUS_CODE_ERROR")).alias("error")))


def jaeger(d: DataFrame) -> DataFrame:
    s = d.select(F.explode("data").alias("t")).select(F.explode("t.spans").alias("x"))
    bad = F.exists("x.tags", lambda t: (t["key"] == "error") & (F.lower(t["value"].cast("string")) == "true"))
    return _span_stats(s.select(F.col("x.operationName").alias("name"), (F.col("x.duration") / 1000).alias("ms"), F.coalesce(bad, F.lit(False)).alias("error")))


def zipkin(d: DataFrame) -> DataFrame:
    error = F.col("tags.error").isNotNull() if "tags" in d.columns else F.lit(False)
    return _span_stats(d.select("name", (F.col("duration") / 1000).alias("ms"), error.alias("error")))


def vulnerabilities(d: DataFrame, kind: str) -> DataFrame:
    """(cve, package, severity, title, source) of npm, pip, trivy, osv or generic report JSON."""
    if kind == "trivy":
        v = d.select(F.explode("Results").alias("r")).select(F.explode("r.Vulnerabilities").alias("v"))
        cols = [F.col("v.VulnerabilityID"), F.col("v.PkgName"), F.lower("v.Severity"), F.col("v.Title")]
    elif kind == "pip":
        v = d.select(F.explode("dependencies").alias("p")).select("p.name", F.explode("p.vulns").alias("v"))
        cols = [F.col("v.id"), F.col("name"), F.lit("unknown"), F.col("v.description")]
    elif kind == "osv":
        v = d.select(F.explode("results").alias("r")).select(F.explode("r.packages").alias("p")).select("p.package.name", F.explode("p.vulnerabilities").alias("v"))
        cols = [F.col("v.id"), F.col("name"), F.lit("unknown"), F.col("v.summary")]
    elif kind == "npm":
        v = d.select(F.explode(F.from_json(F.to_json("vulnerabilities"), "map<string, struct<name:string,severity:string,via:string>>")).alias("k", "v"))
        cols = [F.coalesce(F.regexp_extract("v.via", "(GHSA-[\\w-]+|CVE-[\\d-]+)", 1), F.lit("")), F.col("k"), F.lower("v.severity"), F.lit("")]
    else:
        v, cols = d, [F.col("cve"), F.col("package"), F.lower("severity"), F.col("title")]
    return v.select(*[c.alias(n) for c, n in zip(cols, ("cve", "package", "severity", "title"), strict=True)], F.lit(kind).alias("source"))


def _walk(tree: ast.AST, path: str) -> tuple[list[tuple], list[tuple]]:
    symbols, refs = [], []

    def visit(node: ast.AST, outer: str) -> None:
        for x in ast.iter_child_nodes(node):
            name = outer
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{outer}.{x.name}" if outer else x.name
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                symbols.append((path, x.name, name, kind, x.lineno, x.end_lineno, ast.get_docstring(x)))
                for b in getattr(x, "bases", []):
                    refs.append((path, name, ast.unparse(b), "inherits", x.lineno))
            elif isinstance(x, ast.Call):
                refs.append((path, outer, ast.unparse(x.func).split(".")[-1], "call", x.lineno))
            elif isinstance(x, ast.Import | ast.ImportFrom):
                refs.extend((path, outer, a.name, "import", x.lineno) for a in x.names)
            visit(x, name)

    visit(tree, "")
    return symbols, refs


def python_symbols(sources: DataFrame) -> DataFrame:
    """(path, name, qualified, kind, line_start, line_end, docstring) from (path, text); texts that don't parse give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"], strict=True) for r in _parsed(p, t)[0]], columns=["path", "name", "qualified", "kind", "line_start", "line_end", "docstring"])

    return sources.select("path", "text").mapInPandas(run, "path string, name string, qualified string, kind string, line_start long, line_end long, docstring string")


def python_references(sources: DataFrame) -> DataFrame:
    """(path, source, target, kind, line) from (path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, t in zip(b["path"], b["text"], strict=True) for r in _parsed(p, t)[1]], columns=["path", "source", "target", "kind", "line"])

    return sources.select("path", "text").mapInPandas(run, "path string, source string, target string, kind string, line long")


def _parsed(path: str, text: str | None) -> tuple[list[tuple], list[tuple]]:
    try:
        return _walk(ast.parse(text or ""), path)
    except (SyntaxError, ValueError, RecursionError):
        return [], []
