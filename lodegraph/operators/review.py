"""Questions asked before and after a change: may this go, what else must change, what breaks, what got worse.

All are joins and pre-aggregated group-bys; names with many candidates are aggregated before they are joined.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut, tasks_for
from . import graph as G

#: First parts of names that outside callers may use.
API_PREFIXES = ("get", "use", "create", "validate", "fetch", "update", "delete", "find", "check", "make", "build", "parse", "format")
UTILITY = "(?i)util|helper|common|shared|(^|/)lib/|compat|polyfill|types|constants"
_c = F.col


def safe_delete(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, callers, tests, dependents, verdict): direct callers outside and inside tests, all that reach the symbol, and
    SAFE, REVIEW or UNSAFE. Exported symbols with a name like a public interface's are REVIEW at least."""
    of = symbols.select(_c("id").alias("src"), "file_id").join(files.select(_c("id").alias("file_id"), "is_test"), "file_id")
    direct = edges.join(of, "src").groupBy(_c("dst").alias("id")).agg(F.count_if(_c("is_test") == 0).alias("callers"), F.count_if(_c("is_test") == 1).alias("tests"))
    reach = G.closure(edges.select("src", "dst")).filter("src <> dst").groupBy(_c("dst").alias("id")).agg(F.count(F.lit(1)).alias("dependents"))
    d = symbols.select("id", "name", "is_exported").join(direct, "id", "left").join(reach, "id", "left").fillna(0, ["callers", "tests", "dependents"])
    public = (_c("is_exported") == 1) & reduce(lambda a, b: a | b, [F.lower("name").startswith(p) for p in API_PREFIXES])
    verdict = F.when((_c("callers") == 0) & (_c("dependents") == 0), F.when(public, "REVIEW").otherwise("SAFE")).when(_c("callers") <= 3, "REVIEW").otherwise("UNSAFE")
    return d.select("id", "callers", "tests", "dependents", verdict.alias("verdict"))


def change_set(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_id, change, places): the files that a change of a symbol touches, each once under its first kind: definition,
    update_test, update_import, update_call."""
    own = symbols.select("id", "file_id", F.lit(0).alias("rank"))
    of = symbols.select(_c("id").alias("src"), "file_id").join(files.select(_c("id").alias("file_id"), "is_test"), "file_id")
    kind = F.when(_c("is_test") == 1, 1).when(_c("kind") == "import", 2).otherwise(3)
    d = own.unionByName(edges.join(of, "src").select(_c("dst").alias("id"), "file_id", kind.alias("rank")))
    d = d.groupBy("id", "file_id").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("places"))
    return d.select("id", "file_id", F.element_at(F.array(*map(F.lit, ("definition", "update_test", "update_import", "update_call"))), _c("rank") + 1).alias("change"), "places")


def cycle_report(labels: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(scc, size, files, dirs, severity) of every cycle: one folder INFO, over three files CRITICAL, else WARNING."""
    d = labels.join(symbols.select("id", "file_id"), "id").join(files.select(_c("id").alias("file_id"), "dir"), "file_id")
    d = d.groupBy("scc").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("file_id").alias("files"), F.count_distinct("dir").alias("dirs")).filter("size > 1")
    return d.withColumn("severity", F.when(_c("dirs") == 1, "INFO").when(_c("files") > 3, "CRITICAL").otherwise("WARNING"))


def weakest_edges(labels: DataFrame, edges: DataFrame, limit: int = 500) -> DataFrame:
    """(scc, src, dst): the edge of each cycle whose removal most likely breaks it. Components up to `limit` nodes: greatest
    edge betweenness inside; larger: most outgoing edges of the source, then most incoming of the target. Ties: smallest."""
    a, b = labels.select(_c("id").alias("src"), "scc"), labels.select(_c("id").alias("dst"), _c("scc").alias("other"))
    inner = cut(edges.select("src", "dst").distinct().filter("src <> dst").join(a, "src").join(b, "dst").filter("scc = other").select("scc", "src", "dst"))
    size = labels.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))

    def central(d: pd.DataFrame) -> pd.DataFrame:
        to: dict[int, list[int]] = {}
        for s, t in zip(d["src"].tolist(), d["dst"].tolist(), strict=True):
            to.setdefault(s, []).append(t)
        total: dict[tuple[int, int], float] = {}
        for s in sorted(to):
            for e, x in G._brandes(to, s)[1].items():
                total[e] = total.get(e, 0.0) + x
        src, dst = min(total, key=lambda e: (-round(total[e], 9), e))
        return pd.DataFrame({"scc": [int(d["scc"].iloc[0])], "src": [src], "dst": [dst]})

    small = inner.join(size.filter(_c("n") <= limit).select("scc"), "scc").groupBy("scc").applyInPandas(lambda d: central(d), "scc long, src long, dst long")
    large = inner.join(size.filter(_c("n") > limit).select("scc"), "scc")
    out, into = large.groupBy("scc", "src").agg(F.count(F.lit(1)).alias("o")), large.groupBy("scc", "dst").agg(F.count(F.lit(1)).alias("i"))
    best = large.join(out, ["scc", "src"]).join(into, ["scc", "dst"]).groupBy("scc").agg(F.max(F.struct("o", "i", (-_c("src")).alias("s"), (-_c("dst")).alias("d"))).alias("t"))
    return small.unionByName(best.select("scc", (-_c("t.s")).alias("src"), (-_c("t.d")).alias("dst")))


def deepest_chain(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, id): a longest path of the condensation, from its source; a component stands as its member of greatest degree.
    Of equal choices the smallest id. One lookup a layer."""
    labels = cut(G.layered(vertices, edges))
    layer = cut(labels.groupBy("scc").agg(F.max("layer").alias("layer")))
    a, b = layer.select(_c("scc").alias("src"), _c("layer").alias("la")), layer.select(_c("scc").alias("dst"), _c("layer").alias("lb"))
    before = cut(G.condensed(edges, labels).join(a, "src").join(b, "dst").filter("lb = la + 1").groupBy("dst").agg(F.min("src").alias("src")))
    last = layer.orderBy(F.desc("layer"), "scc").first()
    chain = [] if last is None else [last["scc"]]
    for _ in range(last["layer"] if last else 0):
        chain.append(before.filter(_c("dst") == chain[-1]).first()["src"])
    steps = vertices.sparkSession.createDataFrame(list(enumerate(reversed(chain))), "step long, scc long")
    deg = edges.select("src", "dst").distinct().select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    who = labels.join(F.broadcast(steps), "scc").join(deg, "id", "left").groupBy("step").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), (-_c("id")).alias("i"))).alias("t"))
    return who.select("step", (-_c("t.i")).alias("id"))


def _dirs(labels: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    d = labels.join(symbols.select("id", "file_id"), "id").join(files.select(_c("id").alias("file_id"), "dir"), "file_id")
    return d.groupBy("cluster", "dir").agg(F.count(F.lit(1)).alias("n"))


def cluster_labels(labels: DataFrame, symbols: DataFrame, files: DataFrame, rank: DataFrame, most: int = 100) -> DataFrame:
    """(cluster, label): the majority folder and the name of greatest rank, of anchor kinds if there are any; clusters above
    `most` members or 40 % of the graph over several folders list their three largest folders with percentages."""
    by = _dirs(labels, symbols, files)
    order = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "dir"))
    short = F.substring_index("dir", "/", -1)
    top = by.withColumn("r", order).filter("r <= 3").withColumn("short", short)
    size = by.groupBy("cluster").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("dirs"))
    top = top.join(size, "cluster").groupBy("cluster").agg(
        F.min(F.when(_c("r") == 1, _c("short"))).alias("dir"), F.first("size").alias("size"), F.first("dirs").alias("dirs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "short", F.round(100.0 * _c("n") / _c("size")).cast("int").alias("pct")))), lambda x: F.concat(x["short"], F.lit(" "), x["pct"], F.lit("%"))), " + ").alias("parts"),
    )
    anchor = _c("kind").isin("class", "struct", "interface").cast("int")
    best = labels.join(symbols.select("id", "name", "kind"), "id").join(rank, "id").groupBy("cluster").agg(F.max_by("name", F.struct(anchor.alias("a"), "rank", (-_c("id")).alias("i"))).alias("name"))
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    d = top.join(best, "cluster").crossJoin(F.broadcast(n))  # one row
    mega = ((_c("size") > most) | (_c("size") > 0.4 * _c("n"))) & (_c("dirs") > 1)
    return d.select("cluster", F.when(mega, _c("parts")).otherwise(F.concat("dir", F.lit("/"), "name")).alias("label"))


def cluster_mismatch(labels: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(cluster, dirs, mismatch) of clusters over several folders: members outside the majority folder."""
    d = _dirs(labels, symbols, files).groupBy("cluster").agg(F.count(F.lit(1)).alias("dirs"), (F.sum("n") - F.max("n")).alias("mismatch"))
    return d.filter("dirs > 1")


def leak_edges(labels: DataFrame, weights: DataFrame, k: int = 20) -> DataFrame:
    """The k edges (src, dst, betweenness) of greatest betweenness that cross clusters."""
    a, b = labels.select(_c("id").alias("src"), _c("cluster").alias("ca")), labels.select(_c("id").alias("dst"), _c("cluster").alias("cb"))
    return weights.join(a, "src").join(b, "dst").filter("ca <> cb").select("src", "dst", "betweenness").orderBy(F.desc("betweenness"), "src", "dst").limit(k)


def adaptive_damping(labels: DataFrame) -> DataFrame:
    """One row (damping): 0.92 less a tenth of the share of nodes on cycles."""
    n = labels.groupBy("scc").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(0.92 - 0.10 * F.sum(F.when(_c("n") > 1, _c("n")).otherwise(0)) / F.sum("n"), 3).alias("damping"))


def ego_graph(edges: DataFrame, centre: DataFrame, radius: int = 2) -> DataFrame:
    """The edges among the nodes within `radius` steps of `centre` (id), either way."""
    near = cut(G.reach(edges.select("src", "dst").unionByName(G.reverse(edges)), centre.select(_c("id").alias("node")), radius).select("node"))
    return edges.select("src", "dst").join(near.select(_c("node").alias("src")), "src", "left_semi").join(near.select(_c("node").alias("dst")), "dst", "left_semi")


def fan(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, files_in, files_out): distinct neighbours, and distinct other files that they lie in."""
    of = lambda k: symbols.select(_c("id").alias(k), _c("file_id").alias(f"f_{k}"))
    e = edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst")
    other = _c("f_src") != _c("f_dst")
    i = e.groupBy(_c("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"), F.count_distinct(F.when(other, _c("f_src"))).alias("files_in"))
    o = e.groupBy(_c("src").alias("id")).agg(F.count(F.lit(1)).alias("fan_out"), F.count_distinct(F.when(other, _c("f_dst"))).alias("files_out"))
    return symbols.select("id").join(i, "id", "left").join(o, "id", "left").fillna(0)


def top_exports(symbols: DataFrame, rank: DataFrame, k: int = 2) -> DataFrame:
    """(file_id, place, id): the k exported symbols of greatest rank of each file."""
    place = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("rank"), "id"))
    return symbols.filter("is_exported = 1").select("id", "file_id").join(rank, "id").withColumn("place", place).filter(_c("place") <= k).select("file_id", "place", "id")


def bisect(series: DataFrame, better_up: Column) -> DataFrame:
    """(series, idx, before, after, delta, direction) of each step of a metric, by whether a rise is good (`better_up`)."""
    d = series.withColumn("before", F.lag("value").over(Window.partitionBy("series").orderBy("idx"))).filter(_c("before").isNotNull())
    delta = _c("value") - _c("before")
    way = F.when(delta == 0, "unchanged").when((delta > 0) == better_up, "improved").otherwise("degraded")
    return d.select("series", "idx", "before", _c("value").alias("after"), F.round(delta, 2).alias("delta"), way.alias("direction"))


def rate_alerts(series: DataFrame, worse_up: Column, percent: float = 20.0) -> DataFrame:
    """(series, before, value, level): series whose last step got worse by over `percent` (WARNING), or that rose from 0 (INFO)."""
    last = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("idx")))
    d = series.withColumn("before", F.lag("value").over(Window.partitionBy("series").orderBy("idx"))).withColumn("r", last).filter("r = 1 AND before IS NOT NULL")
    worse = F.when(worse_up, _c("value") > _c("before")).otherwise(_c("value") < _c("before"))
    level = F.when((_c("before") == 0) & worse, "INFO").when((_c("before") != 0) & worse & (100 * F.abs(_c("value") - _c("before")) / F.abs("before") > percent), "WARNING")
    return d.select("series", "before", "value", level.alias("level")).filter("level IS NOT NULL")


def forecast_status(trend: DataFrame, current: DataFrame, limits: DataFrame, horizon: int = 5, flat: float = 0.05) -> DataFrame:
    """(series, current, slope, forecast, status): stable, trending, warning or alert, by trend (series, slope), current
    (series, current) and limits (series, warning, critical, better_up)."""
    d = trend.select("series", "slope").join(current, "series").join(limits, "series").withColumn("forecast", _c("current") + _c("slope") * horizon)
    past = lambda x, t: F.when(_c("better_up"), _c(x) <= _c(t)).otherwise(_c(x) >= _c(t))
    status = F.when(F.abs("slope") < flat, "stable").when(past("current", "critical"), "alert").when(past("current", "warning"), "warning").when(past("forecast", "critical"), "alert").when(past("forecast", "warning"), "warning").otherwise("trending")
    return d.select("series", "current", "slope", "forecast", status.alias("status"))


def at_risk(symbols: DataFrame, metrics: DataFrame, churn: DataFrame, least: float = 10.0) -> DataFrame:
    """(id, score): cc (1 + churn of its file / greatest churn) of symbols where that reaches `least`. churn: (file_id, churn)."""
    top = churn.agg(F.greatest(F.max("churn"), F.lit(1)).alias("most"))
    d = symbols.select("id", "file_id").join(metrics.select(_c("symbol_id").alias("id"), "cc"), "id").join(churn, "file_id", "left").crossJoin(F.broadcast(top))  # one row
    return d.select("id", (_c("cc") * (1 + F.coalesce("churn", F.lit(0)) / _c("most"))).alias("score")).filter(_c("score") >= least)


def match_spans(spans: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(name, file, id, how) of distinct spans (name, file): the one symbol of that name whose path ends with the file, else
    the one symbol of that name, else none. Paths' ends of the lengths that files have are joined with them, so frequent
    names multiply nothing; the lengths are one row, at most as many as the longest path has letters."""
    want = spans.select("name", "file").distinct()
    n = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    s = symbols.select(_c("id").alias("sid"), "name", "file_id").join(files.select(_c("id").alias("file_id"), "path"), "file_id")
    look = want.filter(_c("file").isNotNull()).withColumn("end", F.regexp_replace("file", r"\\\\", "/"))
    longest = files.agg(F.max(F.length("path")).alias("longest"))
    lengths = look.select(F.length("end").alias("l")).distinct().crossJoin(F.broadcast(longest)).filter("l <= longest").agg(F.collect_list("l").alias("ls"))  # one row
    tasks = tasks_for(symbols, 1 << 17)  # a few bytes of a column stand for many ends
    tails = s.repartition(tasks, "sid").crossJoin(F.broadcast(lengths)).select("sid", "name", "path", F.explode(F.filter("ls", lambda x: x <= F.length("path"))).alias("l")).select("sid", "name", F.expr("right(path, l)").alias("end"))
    tails = tails.repartition(tasks, "name", "end").groupBy("name", "end").agg(F.count(F.lit(1)).alias("m"), F.min("sid").alias("here"))
    ends = look.join(tails, ["name", "end"]).select("name", "file", "m", "here")
    d = want.join(n, "name", "left").join(ends.withColumnsRenamed({"name": "en", "file": "ef"}), (_c("name") == _c("en")) & (_c("file") == _c("ef")), "left")
    exact, alone = _c("m") == 1, _c("n") == 1
    return d.select("name", "file", F.when(exact, _c("here")).when(alone, _c("only")).alias("id"), F.when(exact, "path").when(alone, "name").otherwise("none").alias("how"))


def match_packages(packages: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, id, how): symbols called like a package (name), with it as a part of their dotted qualified name (qualified), or
    that import a symbol of that name (import); the first of these."""
    p = packages.select("package").distinct()
    name = symbols.join(p, _c("name") == _c("package")).select("package", "id", F.lit(0).alias("r"))
    parts = symbols.select("id", F.explode(F.array_distinct(F.split("qualified", r"\.|::|/"))).alias("part")).join(p, _c("part") == _c("package")).select("package", "id", F.lit(1).alias("r"))
    imports = edges.filter("kind = 'import'").select(_c("src"), _c("dst").alias("id")).distinct().join(name.select("package", "id"), "id").select("package", _c("src").alias("id"), F.lit(2).alias("r"))
    d = name.unionByName(parts).unionByName(imports).groupBy("package", "id").agg(F.min("r").alias("r"))
    return d.select("package", "id", F.element_at(F.array(*map(F.lit, ("name", "qualified", "import"))), _c("r") + 1).alias("how"))


def best_match(refs: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, id, how) of references (ref, name, kind, file, dir, parent, import_dir): the symbol that a name means. Alone; a
    call of an upper-case name means a class (same file, same folder, first); same file (first under the same parent); same
    folder (exported first); the imported folder (exported first); exported; first. First is the smallest id. Candidates are
    reduced to one for each name and place before they are joined, so frequent names multiply nothing. The candidates grow with
    the symbols: they are merged, as broadcasts would pass through the driver."""
    s = symbols.select("id", "name", "kind", "qualified", "is_exported", "file_id").join(files.select(_c("id").alias("file_id"), "path", "dir").hint("merge"), "file_id")
    klass, shown = _c("kind") == "class", _c("is_exported") == 1
    pick = lambda when: F.min(F.when(when, _c("id"))) if when is not None else F.min("id")
    first = lambda by, p: s.groupBy(*[_c(b).alias(f"{p}_{b}") for b in by]).agg(F.count(F.lit(1)).alias(f"{p}_n"), pick(None).alias(f"{p}_any"), pick(shown).alias(f"{p}_shown"), pick(klass).alias(f"{p}_class")).hint("merge")
    scope = s.withColumn("scope", F.regexp_extract("qualified", r"^(.*?)(\.|::)[^.:]*$", 1)).groupBy(_c("name").alias("s_name"), _c("path").alias("s_path"), _c("scope").alias("s_scope")).agg(F.min("id").alias("s_any")).hint("merge")
    d = refs.join(first(["name"], "a"), _c("name") == _c("a_name"), "left").join(first(["name", "path"], "f"), (_c("name") == _c("f_name")) & (_c("file") == _c("f_path")), "left")
    d = d.join(first(["name", "dir"], "d"), (_c("name") == _c("d_name")) & (_c("dir") == _c("d_dir")), "left").join(first(["name", "dir"], "i"), (_c("name") == _c("i_name")) & (_c("import_dir") == _c("i_dir")), "left")
    d = d.join(scope, (_c("name") == _c("s_name")) & (_c("file") == _c("s_path")) & (_c("parent") == _c("s_scope")), "left")
    make = (_c("kind") == "call") & _c("name").rlike("^[A-Z]") & _c("a_class").isNotNull()
    rules = [
        (_c("a_n").isNull(), F.lit(None).cast("long"), "none"), (_c("a_n") == 1, _c("a_any"), "alone"), (make, F.coalesce("f_class", "d_class", "a_class"), "class"),
        (_c("f_any").isNotNull(), F.coalesce(F.when(_c("f_n") > 1, _c("s_any")), "f_any"), "file"), (_c("d_any").isNotNull(), F.coalesce("d_shown", "d_any"), "dir"),
        (_c("i_any").isNotNull(), F.coalesce("i_shown", "i_any"), "import"), (_c("a_shown").isNotNull(), _c("a_shown"), "exported"),
    ]
    found = reduce(lambda w, r: w.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(_c("a_any"))
    how = reduce(lambda w, r: w.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise("first")
    return d.select("ref", found.alias("id"), how.alias("how"))


def breaking(old: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """(qualified, change, to) between exported symbols (qualified, name, kind, file_id, signature): signature, renamed, removed.
    A rename is the pair of a removed and an added symbol of one file and kind whose names are each other's most similar
    (1 - edit distance / longer length, at least `least`)."""
    o, n = old.withColumnsRenamed({x: f"o_{x}" for x in old.columns}), new.withColumnsRenamed({x: f"n_{x}" for x in new.columns})
    both = o.join(n, _c("o_qualified") == _c("n_qualified"), "full")
    changed = both.filter("o_signature <> n_signature").select(_c("o_qualified").alias("qualified"), F.lit("signature").alias("change"), F.lit(None).cast("string").alias("to"))
    gone, added = cut(both.filter("n_qualified IS NULL").select(*o.columns)), both.filter("o_qualified IS NULL").select(*n.columns)
    like = 1 - F.levenshtein("o_name", "n_name") / F.greatest(F.length("o_name"), F.length("n_name"), F.lit(1))
    pairs = cut(gone.join(added, (_c("o_file_id") == _c("n_file_id")) & (_c("o_kind") == _c("n_kind"))).select("o_qualified", "n_qualified", like.alias("like")).filter(_c("like") >= least))
    rank = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("like"), other))
    renamed = pairs.withColumn("r", rank("o_qualified", "n_qualified")).withColumn("q", rank("n_qualified", "o_qualified")).filter("r = 1 AND q = 1").select("o_qualified", "n_qualified")
    lost = gone.select("o_qualified").join(renamed, "o_qualified", "left")
    return changed.unionByName(lost.select(_c("o_qualified").alias("qualified"), F.when(_c("n_qualified").isNull(), "removed").otherwise("renamed").alias("change"), _c("n_qualified").alias("to")))


def modification_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, uses, advice): safe without incoming edges, careful from three on, else moderate."""
    d = symbols.select("id").join(edges.groupBy(_c("dst").alias("id")).agg(F.count(F.lit(1)).alias("uses")), "id", "left").fillna(0)
    return d.withColumn("advice", F.when(_c("uses") == 0, "safe").when(_c("uses") >= 3, "careful").otherwise("moderate"))


def test_map(symbols: DataFrame, edges: DataFrame, file_edges: DataFrame, files: DataFrame) -> DataFrame:
    """(id, direct, importers): edges into a symbol from test files, and test files that import its file."""
    tests = files.filter("is_test = 1").select(_c("id").alias("t"))
    of = symbols.select(_c("id").alias("src"), _c("file_id").alias("t")).join(tests, "t", "left_semi").select("src")
    direct = edges.join(of, "src").groupBy(_c("dst").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    imports = file_edges.join(tests, _c("src") == _c("t")).groupBy(_c("dst").alias("file_id")).agg(F.count_distinct("src").alias("importers"))
    return symbols.select("id", "file_id").join(direct, "id", "left").join(imports, "file_id", "left").select("id", F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("importers", F.lit(0)).alias("importers"))


def within_budget(items: DataFrame, text: str, rank: str, tokens: int) -> DataFrame:
    """(id, tokens, upto): items by falling rank while the running sum of a quarter of their text's length, one at least,
    stays within `tokens`; only the first `tokens` items can, so no more are sorted in one task."""
    d = items.select("id", _c(rank).alias("rank"), F.greatest(F.floor(F.length(text) / 4), F.lit(1)).alias("tokens")).orderBy(F.desc("rank"), "id").limit(tokens)
    run = F.sum("tokens").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rank"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("upto", run).filter(_c("upto") <= tokens).select("id", "tokens", "upto")


def indentation(text: Column) -> Column:
    """Mean indent of lines that aren't blank times the greatest (a tab or four spaces each count 1), to two digits; 0 without."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r"), lambda x: x.rlike(r"\S"))
    lead = F.transform(lines, lambda x: F.regexp_extract(x, r"^(\s*)", 1))
    units = F.transform(lead, lambda x: F.length(F.regexp_replace(x, "[^\t]", "")) + F.length(F.regexp_replace(x, "\t", "")) / 4.0)
    mean = F.aggregate(units, F.lit(0.0), lambda s, x: s + x) / F.size(units)
    return F.when(F.size(lines) > 0, F.round(mean * F.array_max(units), 2)).otherwise(0.0)


def is_utility(path: Column) -> Column:
    """Whether a path looks like helpers, for which thresholds are laxer."""
    return path.rlike(UTILITY)
