"""Cross-language, multi-repository and framework analyzers: link generators as equi-joins, checks as filters over extracted
rows. Text scans that need a stack run per file in bounded groups."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pairs import listed, paired

_c = F.col

SERVICE_SUFFIXES = ("client", "server", "stub", "servicer", "service", "grpc", "impl", "base", "handler")


def stem_name(path: Column) -> Column:
    """File name without folders and extensions."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\..*$", "")


def protobuf_bridge(protos: DataFrame, symbols: DataFrame) -> DataFrame:
    """(proto_id, symbol_id, link): messages (id, name, kind) to generated symbols by lower-case name; services also by name and a
    usual suffix, with or without underscore. Frequent names make many pairs, so ids are joined as lists and the pairs of
    lists are dealt out; suffixes are exploded on the lists."""
    s = listed(symbols.select(F.lower("name").alias("key"), _c("id").alias("symbol_id")), ["key"], "symbol_id", "symbol_id")
    p = protos.withColumn("key", F.lower("name"))
    plain = listed(p.select("key", _c("id").alias("proto_id")), ["key"], "proto_id", "proto_id").withColumn("link", F.lit("message"))
    ends = F.array(*[F.lit(x) for x in SERVICE_SUFFIXES], *[F.lit(f"_{x}") for x in SERVICE_SUFFIXES])
    service = listed(p.filter("kind = 'service'").select("key", _c("id").alias("proto_id")), ["key"], "proto_id", "proto_id")
    service = service.select(F.explode(F.transform(ends, lambda e: F.concat("key", e))).alias("key"), "proto_id_no", "proto_id", F.lit("service").alias("link"))
    return paired(plain.unionByName(service).join(s, "key"), "proto_id", "symbol_id", "link").select("proto_id", "symbol_id", "link")


def config_bridge(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """(key_id, use_id, confidence): exact, case-insensitive, or first dotted segment; the best of each pair. A pair of two keys
    meets in one way only, so only ids of several keys can make a pair twice: those are grouped, the others' pairs, which
    are many for frequent keys, are made from lists and dealt out."""
    several = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    k, u = (d.select("id", "key").filter("key IS NOT NULL").distinct().withColumn("several", several) for d in (keys, uses))
    k = listed(k.withColumnsRenamed({"id": "key_id", "several": "ks"}), ["key", "ks"], "key_id", "key_id")
    u = listed(u.withColumnsRenamed({"id": "use_id", "key": "used", "several": "us"}), ["used", "us"], "use_id", "use_id")
    lower = k.withColumn("l", F.lower("key")).join(u.withColumn("l", F.lower("used")), "l").withColumn("p", F.when(_c("key") == _c("used"), 3).otherwise(2)).drop("l")
    head = k.join(u.filter(_c("used").contains(".")).withColumn("h", F.substring_index("used", ".", 1)), _c("key") == _c("h")).withColumn("p", F.lit(1)).drop("h")
    lists = lower.unionByName(head)
    once = paired(lists.filter("NOT ks AND NOT us"), "key_id", "use_id", "p")
    again = paired(lists.filter("ks OR us"), "key_id", "use_id", "p").groupBy("key_id", "use_id").agg(F.max("p").alias("p"))
    return once.unionByName(again).select("key_id", "use_id", F.when(_c("p") == 3, 1.0).when(_c("p") == 2, 0.9).otherwise(0.85).alias("confidence"))


def template_bridge(templates: DataFrame, symbols: DataFrame) -> DataFrame:
    """(template_id, symbol_id): identifiers in template texts joined with symbol names."""
    used = templates.select(_c("id").alias("template_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("\\{\\{\\s*([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("name"))
    return used.join(symbols.select(_c("id").alias("symbol_id"), "name"), "name").select("template_id", "symbol_id")


def test_candidates(path: Column) -> Column:
    """Conventional test paths of a source file, by language (Python, Go, JavaScript, Ruby, Java, C#)."""
    d, n = F.regexp_replace(path, "[^/]*$", ""), stem_name(path)
    ext = F.regexp_extract(path, "\\.([^./]+)$", 1)
    one = lambda e, *ps: F.when(ext == e, F.array(*ps))
    js = lambda e: one(e, F.concat(d, n, F.lit(f".test.{e}")), F.concat(d, n, F.lit(f".spec.{e}")), F.concat(d, F.lit("__tests__/"), n, F.lit(f".test.{e}")))
    return F.coalesce(
        one("py", F.concat(d, F.lit("test_"), n, F.lit(".py")), F.concat(F.lit("tests/test_"), n, F.lit(".py")), F.concat(d, F.lit("tests/test_"), n, F.lit(".py"))),
        one("go", F.concat(d, n, F.lit("_test.go"))), js("js"), js("ts"),
        one("rb", F.concat(F.lit("spec/"), n, F.lit("_spec.rb")), F.concat(F.lit("test/"), n, F.lit("_test.rb"))),
        one("java", F.concat(F.regexp_replace(d, "src/main/", "src/test/"), n, F.lit("Test.java"))),
        one("cs", F.concat(d, n, F.lit("Tests.cs"))),
    )


def convention_tests(files: DataFrame) -> DataFrame:
    """(id, test_id): source files and the test files that their conventions name and that exist."""
    cand = files.select("id", F.explode(test_candidates(_c("path"))).alias("path")).distinct()
    return cand.join(files.select(_c("id").alias("test_id"), "path"), "path").filter("id <> test_id").select("id", "test_id").distinct()


def relink(annotations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Annotations with symbol ids found again by qualified name, the smallest if several; null if gone."""
    s = symbols.groupBy(_c("qualified").alias("q")).agg(F.min("id").alias("new_id"))
    return annotations.join(s, _c("qualified") == _c("q"), "left").drop("q")


def active(annotations: DataFrame, as_of: Column) -> DataFrame:
    return annotations.filter(_c("expires_at").isNull() | (_c("expires_at") > as_of))


def workspace_health(snapshots: DataFrame, links: DataFrame) -> DataFrame:
    """One row: mean of each repository's latest score, cross links, coupling level."""
    last = snapshots.groupBy("repo").agg(F.max_by("score", "ts").alias("score"))
    n = links.agg(F.count(F.lit(1)).alias("links"))
    level = F.when(_c("links") > 50, "high").when(_c("links") > 20, "moderate").otherwise("low")
    return last.agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("repos")).crossJoin(n).withColumn("coupling", level)  # one row each


def camel(name: Column) -> Column:
    parts = F.split(name, "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, 1000), lambda x: F.initcap(x)), ""))


def api_drift(backend: DataFrame, frontend: DataFrame) -> DataFrame:
    """(model, field, level): backend fields (model, field; snake case) against frontend fields (model, field; camel case):
    fields only in front are high, only in the back medium."""
    b = backend.select("model", camel(_c("field")).alias("field"), F.lit(1).alias("b"))
    f = frontend.select("model", "field", F.lit(1).alias("f"))
    both = b.select("model").intersect(f.select("model"))
    d = b.join(f, ["model", "field"], "full").join(both, "model", "left_semi").filter(_c("b").isNull() | _c("f").isNull())
    return d.select("model", "field", F.when(_c("b").isNull(), "high").otherwise("medium").alias("level"))


def over_fetch(models: DataFrame) -> DataFrame:
    """(model, level) from (model, fields, hidden, exposed, direct, selects): how much a serialised model exposes."""
    f, h = _c("fields"), _c("hidden")
    skip = _c("exposed").isNotNull() & (_c("exposed") < 0.5 * f)
    level = F.when(skip, None).when((f >= 30) & (h == 0) & _c("exposed").isNull(), "high").when((f >= 20) & (h < 3), F.when(_c("direct") == 1, "high").otherwise("medium")).when((f >= 10) & (_c("selects") == 0), "low")
    return models.select("model", level.alias("level")).filter(_c("level").isNotNull())


def missing_index(queries: DataFrame, indexes: DataFrame) -> DataFrame:
    """(table, columns, level): filters (table, columns array, paginated) no index (table, columns array) covers: with two or
    more columns an index must hold them all; ids and timestamps need none."""
    q = queries.withColumn("columns", F.array_sort(F.array_distinct(F.filter("columns", lambda x: ~x.rlike("^(id|uuid)$|_at$"))))).filter(F.size("columns") > 0)
    i = indexes.select("table", _c("columns").alias("have"))
    covered = q.join(i, "table").filter(F.size(F.array_except("columns", "have")) == 0).select("table", "columns").distinct()
    d = q.join(covered, ["table", "columns"], "left_anti")
    return d.groupBy("table", "columns").agg(F.max("paginated").alias("p")).select("table", F.array_join("columns", ",").alias("columns"), F.when(_c("p") == 1, "high").otherwise("medium").alias("level"))


def migration_safety(lines: DataFrame, back: int = 30) -> DataFrame:
    """(file, line, level, what) from (file, line, body): creations without a guard in the `back` lines before are high, bare
    drops high, dropped columns medium."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(-back, 0)
    guard = F.max(F.when(_c("body").rlike("(?i)if not exists|hasTable|hasColumn|if exists"), 1).otherwise(0)).over(w)
    what = F.when(_c("body").rlike("(?i)create\\s+table|createTable"), "create").when(_c("body").rlike("(?i)drop\\s+column|dropColumn"), "drop-column").when(_c("body").rlike("(?i)drop\\s+(table|index)|dropTable"), "drop")
    d = lines.withColumn("guard", guard).withColumn("what", what).filter(_c("what").isNotNull() & ((_c("guard") == 0) | (_c("what") == "drop-column")))
    return d.select("file", "line", F.when(_c("what") == "drop-column", "medium").otherwise("high").alias("level"), "what")


_OPEN, _ROUTE, _AUTH, _PUBLIC = re.compile(r"group\("), re.compile(r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)"), re.compile(r"auth|can:|guard", re.I), re.compile(r"public|guest", re.I)


def auth_gaps(lines: DataFrame) -> DataFrame:
    """(file, line, route): routes outside every authenticated group and without a marker of their own. A stack over a file's
    lines, so files are the groups; a route file is small by nature."""

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        depth, stack, out = 0, [], []
        for line, body in d.sort_values("line")[["line", "body"]].itertuples(index=False):
            if m := _ROUTE.search(body):
                if not any(a for _, a in stack) and not _AUTH.search(body) and not _PUBLIC.search(body):
                    out.append((key[0], line, m[2]))
            if _OPEN.search(body) and "{" in body:
                stack.append((depth, bool(_AUTH.search(body))))
            depth += body.count("{") - body.count("}")
            while stack and depth <= stack[-1][0]:
                stack.pop()
        return pd.DataFrame(out, columns=["file", "line", "route"])

    return lines.groupBy("file").applyInPandas(run, "file string, line long, route string")


def entry_protocol(name: Column, path: Column) -> Column:
    """HTTP, CLI, event, job, test or export, by name and path; the first that fits."""
    return F.when(path.rlike("(^|/)(routes|controllers|api)/") | name.rlike("(?i)(route|handler|endpoint)"), "HTTP").when(name.rlike("^(main|cli|cmd_)"), "CLI").when(name.rlike("(?i)(on_|listen|subscribe)"), "Event").when(name.rlike("(?i)(job|task|cron)"), "Job").when(path.rlike("(^|/)tests?/"), "Test").otherwise("Export")


def doc_staleness(symbols: DataFrame, blame: DataFrame, days: int = 90) -> DataFrame:
    """(id, drift): days from the newest documentation line to the newest body line, `days` or more. symbols: (id, file_id,
    doc_start, doc_end, line_end); blame: (file_id, line, ts)."""
    d = symbols.join(blame, "file_id").filter(_c("line").between(_c("doc_start"), _c("line_end")))
    doc = F.max(F.when(_c("line") <= _c("doc_end"), _c("ts")))
    body = F.max(F.when(_c("line") > _c("doc_end"), _c("ts")))
    return d.groupBy("id").agg(((body - doc) / 86400).alias("drift")).filter(_c("drift") >= days)
