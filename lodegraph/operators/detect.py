"""Algorithm and design-pattern detectors, governance rules: filters over symbols joined with signals, unioned by one runner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import any_of, glob_regex

_c = F.col


def called(*names: str) -> Column:
    return F.arrays_overlap(_c("calls"), F.array(*map(F.lit, names)))


def named(*parts: str) -> Column:
    return any_of([_c("name").ilike(f"%{p}%") for p in parts])


@dataclass(frozen=True)
class Detector:
    """A task: which symbols show it, the way they use, why, and how sure (a column of high, medium or low)."""

    task: str
    way: str
    found: Callable[[], Column]
    reason: str
    confidence: Callable[[], Column]
    best: str = ""


def _fixed(level: str) -> Callable[[], Column]:
    return lambda: F.lit(level)


#: One for each task of the catalogue that can be detected.
DETECTORS = [
    Detector("sorting", "manual", lambda: named("sort") & (_c("nested") == 1), "nested loops in a sort", lambda: F.when(_c("subscript") == 1, "high").otherwise("medium"), "library sort, n log n"),
    Detector("search-sorted", "linear", lambda: named("search_sorted", "searchsorted", "find_sorted", "findsorted", "in_sorted", "linear_search", "linearsearch") & (_c("compares") == 1) & (_c("loop_depth") >= 1), "linear scan of sorted data", _fixed("low"), "bisection, log n"),
    Detector("membership", "list", lambda: named("contain", "member", "exist", "has_", "in_", "check", "includes") & (_c("compares") == 1) & (_c("loop_depth") >= 1), "loop that tests membership", _fixed("medium"), "hash set, constant"),
    Detector("string-concat", "append", lambda: (_c("concat") == 1) & (_c("loop_depth") >= 1), "string grown in a loop", lambda: F.when(called("add"), "high").otherwise("medium"), "join, linear"),
    Detector("unique", "nested", lambda: named("unique", "dedup", "distinct", "remove_dup", "removedup") & (_c("nested") == 1) & ~called("add"), "pairwise comparison for uniqueness", _fixed("medium"), "hash set, linear"),
    Detector("max-min", "manual", lambda: named("find_max", "find_min", "findmax", "findmin", "get_max", "get_min", "getmax", "getmin", "find_largest", "find_smallest", "findlargest", "findsmallest") & (_c("compares") == 1), "loop for an extreme", _fixed("low"), "built-in"),
    Detector("accumulation", "manual", lambda: named("sum", "total", "accumulate") & (_c("accumulates") == 1), "loop that adds", _fixed("low"), "built-in sum"),
    Detector("fibonacci", "recursive", lambda: named("fib") & (_c("self_calls") >= 2) & ~_c("memo"), "two self calls without memo", _fixed("high"), "iteration"),
    Detector("nested-lookup", "nested", lambda: (_c("nested") == 1) & (_c("compares") == 1) & (_c("cc") >= 8) & ~named("grid", "matrix"), "lookup in an inner loop", _fixed("medium"), "hash join"),
    Detector("groupby", "manual", lambda: named("group", "bucket", "partition", "categorize", "classify", "bin_by", "key_by", "index_by") & (_c("loop_depth") >= 1), "manual grouping", _fixed("low"), "defaultdict"),
    Detector("busy-wait", "sleep", lambda: called("sleep") & (_c("loop_depth") >= 1) & ~named("poll", "retry"), "sleep in a loop", _fixed("medium"), "event"),
    Detector("regex-in-loop", "inline", lambda: called("compile", "match") & (_c("loop_depth") >= 1), "pattern built in a loop", lambda: F.when(called("compile"), "high").otherwise("medium"), "compile once"),
    Detector("io-in-loop", "single", lambda: called("query", "insert") & (_c("loop_depth") >= 1), "I/O for each element", lambda: F.when(called("query"), "high").otherwise("medium"), "batch"),
    Detector("list-prepend", "insert", lambda: called("insert") & (_c("loop_depth") >= 1) & (_c("subscript") == 1), "insertion at the front in a loop", _fixed("medium"), "deque"),
    Detector("sort-to-select", "sort", lambda: called("sort") & named("top", "kth", "first", "small"), "full sort for a few elements", _fixed("medium"), "heap"),
    Detector("loop-lookup", "index", lambda: called("index") & (_c("loop_depth") >= 1), "index() in a loop", _fixed("high"), "dictionary"),
    Detector("branching-recursion", "recursive", lambda: (_c("self_calls") >= 2) & ~_c("memo") & ~named("walk", "visit", "traverse"), "several self calls", _fixed("medium"), "memo"),
    Detector("quadratic-string", "slice", lambda: (_c("concat") == 1) & (_c("nested") == 1), "string work in nested loops", _fixed("high"), "buffer"),
    Detector("loop-invariant-call", "repeated", lambda: (F.size(F.filter("invariant", lambda x: ~x.isin("now"))) > 0) & (_c("loop_depth") >= 1), "call that doesn't change in the loop", _fixed("medium"), "hoist"),
]
#: Tasks of the catalogue without a detector.
OTHER_TASKS = ("manual-power", "manual-gcd", "string-reverse", "matrix-mult")


def candidates(symbols: DataFrame, signals: DataFrame, metrics: DataFrame, files: DataFrame, memo: DataFrame) -> DataFrame:
    """Symbols outside tests with signals, complexity and whether they have an edge to a memo symbol (id)."""
    f = files.filter("is_test = 0").select(_c("id").alias("file_id"))
    d = symbols.join(f, "file_id", "left_semi").join(signals.withColumnRenamed("symbol_id", "id"), "id").join(metrics.select(_c("symbol_id").alias("id"), "cc"), "id")
    return d.join(memo.select("id", F.lit(True).alias("memo")).distinct(), "id", "left").withColumn("memo", F.coalesce("memo", F.lit(False)))


def detect(found: DataFrame, detectors: list[Detector] = DETECTORS) -> DataFrame:
    """(task_id, way, id, reason, confidence) of all detectors in one scan: an array of hits, exploded."""
    hits = F.array(*[F.when(x.found(), F.struct(F.lit(x.task).alias("task_id"), F.lit(x.way).alias("way"), F.lit(x.reason).alias("reason"), x.confidence().alias("confidence"))) for x in detectors])
    d = found.select("id", "bounded", F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h"))
    return d.select("h.task_id", "h.way", "id", "h.reason", "h.confidence", "bounded")


def calibrated(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Confidence raised from five calls on, lowered without any and for bounded loops."""
    n = edges.filter("kind = 'call'").groupBy(_c("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    level = F.when(_c("confidence") == "high", 3).when(_c("confidence") == "medium", 2).otherwise(1)
    d = hits.join(n, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    new = F.greatest(F.lit(1), F.least(F.lit(3), level + F.when(_c("callers") >= 5, 1).when(_c("callers") == 0, -1).otherwise(0) - F.when(_c("bounded") == 1, 1).otherwise(0)))
    return d.select("task_id", "way", "id", "callers", F.when(new == 3, "high").when(new == 2, "medium").otherwise("low").alias("confidence"))


# design patterns: each returns (pattern, id, confidence)


def _pattern(d: DataFrame, name: str, confidence: Column) -> DataFrame:
    return d.select(F.lit(name).alias("pattern"), "id", confidence.alias("confidence"))


def singleton(s: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with an accessor child; high if a member of the class has an edge to the class."""
    kids = s.filter(_c("parent_id").isNotNull() & _c("name").rlike("^(get_|instance)")).select(_c("parent_id").alias("id")).distinct()
    own = s.filter(_c("parent_id").isNotNull()).select(_c("id").alias("src"), _c("parent_id").alias("dst")).join(edges.select("src", "dst"), ["src", "dst"], "left_semi").select(_c("dst").alias("id"), F.lit(1).alias("own")).distinct()
    d = s.filter("kind = 'class'").join(kids, "id", "left_semi").join(own, "id", "left")
    return _pattern(d, "singleton", F.when(_c("own") == 1, "high").otherwise("medium"))


def factory(s: DataFrame, edges: DataFrame) -> DataFrame:
    to_class = edges.join(s.filter("kind = 'class'").select(_c("id").alias("dst")), "dst", "left_semi").select(_c("src").alias("id"), F.lit(1).alias("makes")).distinct()
    return _pattern(s.filter(_c("name").rlike("(?i)^(create|make|build|get_)")).join(to_class, "id", "left"), "factory", F.when(_c("makes") == 1, "high").otherwise("low"))


def observer(s: DataFrame, edges: DataFrame) -> DataFrame:
    emit, listen = _c("name").rlike("(?i)(emit|notify|red)"), _c("name").rlike("(?i)(subscribe|listen|on_|blue)")
    d = s.filter(_c("parent_id").isNotNull()).groupBy(_c("parent_id").alias("id")).agg(F.max(emit.cast("int")).alias("e"), F.max(listen.cast("int")).alias("l"))
    return _pattern(d.filter("e + l > 0"), "observer", F.when((_c("e") == 1) & (_c("l") == 1), "high").otherwise("medium"))


def repository(s: DataFrame, edges: DataFrame) -> DataFrame:
    crud = s.filter(_c("name").rlike("^(get_|find_|save|delete|sort_)") & _c("parent_id").isNotNull()).select(_c("parent_id").alias("id"), F.lit(1).alias("crud")).distinct()
    return _pattern(s.filter((_c("kind") == "class") & _c("name").rlike("(Repository|Store|Dao|Bolt)$")).join(crud, "id", "left"), "repository", F.when(_c("crud") == 1, "high").otherwise("medium"))


def middleware(s: DataFrame, edges: DataFrame) -> DataFrame:
    like = _c("name").rlike("(?i)(middleware|handler|filter|gear)$")
    near = edges.join(s.filter(like).select(_c("id").alias("dst")), "dst", "left_semi").select(_c("src").alias("id"), F.lit(1).alias("chain")).distinct()
    return _pattern(s.filter(like).join(near, "id", "left"), "middleware", F.when(_c("chain") == 1, "high").otherwise("low"))


def strategy(s: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents with two or more implementations; high if all have a method name in common."""
    impl = edges.join(s.filter("kind IN ('class', 'interface')").select(_c("id").alias("dst")), "dst", "left_semi").select(_c("dst").alias("id"), _c("src").alias("child")).distinct()
    n = impl.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    names = impl.join(s.select(_c("id").alias("child"), "name"), "child").groupBy("id", "name").agg(F.count_distinct("child").alias("c"))
    common = names.join(n, "id").filter("c = n").select("id", F.lit(1).alias("common")).distinct()
    return _pattern(n.join(common, "id", "left"), "strategy", F.when(_c("common") == 1, "high").otherwise("medium"))


def decorator(s: DataFrame, edges: DataFrame) -> DataFrame:
    users = edges.groupBy(_c("dst").alias("id")).agg(F.count_distinct("src").alias("users"))
    return _pattern(s.filter(_c("name").rlike("(?i)(decorator|wrapper|with_|washer)")).join(users, "id", "left"), "decorator", F.when(F.coalesce("users", F.lit(0)) >= 2, "high").otherwise("medium"))


PATTERNS = [singleton, factory, observer, repository, middleware, strategy, decorator]


def patterns(s: DataFrame, edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p(s, edges) for p in PATTERNS])


# governance: each rule gives (rule, id, detail) of its violations


def rule_dependency(edges: DataFrame, files: DataFrame, source: str, target: str, name: str = "dependency") -> DataFrame:
    """Edges from files that match one glob to files that match another."""
    f = files.select("id", "path")
    a = f.filter(_c("path").rlike(glob_regex(source))).select(_c("id").alias("src"), _c("path").alias("sp"))
    b = f.filter(_c("path").rlike(glob_regex(target))).select(_c("id").alias("dst"), _c("path").alias("dp"))
    return edges.join(a, "src").join(b, "dst").select(F.lit(name).alias("rule"), _c("src").alias("id"), F.concat_ws(" -> ", "sp", "dp").alias("detail"))


def rule_metric(metrics: DataFrame, metric: str, most: float, name: str = "metric") -> DataFrame:
    return metrics.filter(_c(metric) > most).select(F.lit(name).alias("rule"), _c("symbol_id").alias("id"), F.concat(F.lit(f"{metric}="), _c(metric).cast("string")).alias("detail"))


def rule_naming(symbols: DataFrame, kind: str, pattern: str, name: str = "naming") -> DataFrame:
    return symbols.filter((_c("kind") == kind) & ~_c("name").rlike(pattern)).select(F.lit(name).alias("rule"), "id", _c("name").alias("detail"))


def rule_paths(files: DataFrame, pattern: str, exempt: list[str] | None = None, name: str = "path") -> DataFrame:
    bad = _c("path").rlike(glob_regex(pattern))
    for e in exempt or []:
        bad = bad & ~_c("path").rlike(glob_regex(e))
    return files.filter(bad).select(F.lit(name).alias("rule"), "id", _c("path").alias("detail"))


def rule_symbols(symbols: DataFrame, degrees: DataFrame, kind: str, most_fan: int, name: str = "symbol") -> DataFrame:
    d = symbols.filter(_c("kind") == kind).join(degrees, "id").filter(_c("out_degree") > most_fan)
    return d.select(F.lit(name).alias("rule"), "id", F.concat(F.lit("fan-out "), _c("out_degree").cast("string")).alias("detail"))


def gate_tests(files: DataFrame, file_edges: DataFrame, least: int, name: str = "gate") -> DataFrame:
    """Source files that fewer than `least` test files import."""
    t = files.filter("is_test = 1").select(_c("id").alias("src"))
    n = file_edges.join(t, "src", "left_semi").groupBy(_c("dst").alias("id")).agg(F.count_distinct("src").alias("tests"))
    d = files.filter("is_test = 0").join(n, "id", "left").withColumn("tests", F.coalesce("tests", F.lit(0))).filter(_c("tests") < least)
    return d.select(F.lit(name).alias("rule"), "id", F.concat(_c("tests").cast("string"), F.lit(" tests")).alias("detail"))


def budget(deltas: DataFrame, limits: DataFrame) -> DataFrame:
    """(metric, delta, verdict): deltas against (metric, max_increase, max_decrease); SKIP without a base value."""
    d = limits.join(deltas, "metric", "left")
    bad = (_c("max_increase").isNotNull() & (_c("delta") > _c("max_increase"))) | (_c("max_decrease").isNotNull() & (-_c("delta") > _c("max_decrease")))
    return d.select("metric", "delta", F.when(_c("base").isNull(), "SKIP").when(bad, "FAIL").otherwise("PASS").alias("verdict"))
