"""Queries of the review operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import graph as G
from ..operators import review as V
from ..operators import series as S
from ..sources.adapters import Tables, oracle
from .graphs import CLO, LAY, SCC
from .registry import query

_RANK = "(id * 7919 % 1009)"
_PUBLIC = "(is_exported = 1 AND (" + " OR ".join(f"starts_with(lower(name), '{p}')" for p in V.API_PREFIXES) + "))"
_DIRS = ", by_dir AS (SELECT cluster, dir, count(*) AS n FROM labelled JOIN symbols USING (id) JOIN files f ON f.id = file_id GROUP BY 1, 2)"


def _rank(t: Tables) -> DataFrame:
    """A rank that SQL can say too."""
    return t.symbols.select("id", (F.col("id") * 7919 % 1009).alias("rank"))


@query(
    "safe_delete",
    oracle(
        CLO + ", d AS (SELECT e.dst AS id, count(*) FILTER (is_test = 0) AS callers, count(*) FILTER (is_test = 1) AS tests FROM edges e JOIN symbols s ON s.id = e.src JOIN files f ON f.id = s.file_id GROUP BY 1), r AS (SELECT dst AS id, count(*) AS dependents FROM clo WHERE src <> dst GROUP BY 1), "
        "x AS (SELECT s.id, name, is_exported, coalesce(callers, 0) AS callers, coalesce(tests, 0) AS tests, coalesce(dependents, 0) AS dependents FROM symbols s LEFT JOIN d ON d.id = s.id LEFT JOIN r ON r.id = s.id) "
        f"SELECT id, callers, tests, dependents, CASE WHEN callers = 0 AND dependents = 0 THEN CASE WHEN {_PUBLIC} THEN 'REVIEW' ELSE 'SAFE' END WHEN callers <= 3 THEN 'REVIEW' ELSE 'UNSAFE' END AS verdict FROM x",
        recursive=True,
    ),
)
def safe_delete(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.safe_delete(t.symbols, t.edges, t.files)


@query(
    "change_set",
    oracle(
        ", u AS (SELECT id, file_id, 0 AS r FROM symbols UNION ALL SELECT e.dst, s.file_id, CASE WHEN is_test = 1 THEN 1 WHEN e.kind = 'import' THEN 2 ELSE 3 END FROM edges e JOIN symbols s ON s.id = e.src JOIN files f ON f.id = s.file_id) "
        "SELECT id, file_id, ['definition', 'update_test', 'update_import', 'update_call'][min(r) + 1] AS change, count(*) AS places FROM u GROUP BY 1, 2"
    ),
)
def change_set(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.change_set(t.symbols, t.edges, t.files)


@query("cycle_severity", oracle(SCC + ", c AS (SELECT scc, count(*) AS size, count(DISTINCT file_id) AS files, count(DISTINCT dir) AS dirs FROM sc JOIN symbols s ON s.id = sc.id JOIN files f ON f.id = file_id GROUP BY 1) SELECT *, CASE WHEN dirs = 1 THEN 'INFO' WHEN files > 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM c WHERE size > 1", recursive=True))
def cycle_severity(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.cycle_report(G.scc(t.symbols, t.graph), t.symbols, t.files)


@query("weakest_edges")
def weakest_edges(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.weakest_edges(G.scc(t.symbols, t.graph), t.graph)


@query(
    "deepest_chain",
    oracle(
        LAY + ", ll AS (SELECT DISTINCT sc.scc, layer FROM sc JOIN lay USING (id)), pre AS (SELECT d.dst, min(d.src) AS src FROM dag d JOIN ll a ON a.scc = d.src JOIN ll b ON b.scc = d.dst WHERE b.layer = a.layer + 1 GROUP BY 1), "
        "top AS (SELECT scc, layer FROM ll ORDER BY layer DESC, scc LIMIT 1), ch AS (SELECT scc, layer AS step FROM top UNION ALL SELECT pre.src, step - 1 FROM ch JOIN pre ON pre.dst = ch.scc), "
        "dg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM graph UNION ALL SELECT dst FROM graph) GROUP BY 1) SELECT step, max_by(sc.id, struct_pack(d := coalesce(d, 0), i := -sc.id)) AS id FROM ch JOIN sc ON sc.scc = ch.scc LEFT JOIN dg ON dg.id = sc.id GROUP BY 1",
        recursive=True,
    ),
)
def deepest_chain(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.deepest_chain(t.symbols, t.graph)


@query(
    "cluster_labels",
    oracle(
        _DIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, dir) AS r, sum(n) OVER (PARTITION BY cluster) AS size, count(*) OVER (PARTITION BY cluster) AS dirs FROM by_dir), "
        "t AS (SELECT cluster, min(split_part(dir, '/', -1)) FILTER (r = 1) AS dir, any_value(size) AS size, any_value(dirs) AS dirs, string_agg(split_part(dir, '/', -1) || ' ' || CAST(round(100.0 * n / size) AS INT) || '%', ' + ' ORDER BY r) AS parts FROM r WHERE r <= 3 GROUP BY 1), "
        f"b AS (SELECT cluster, max_by(name, struct_pack(a := CAST(kind IN ('class', 'struct', 'interface') AS INT), r := {_RANK}, i := -id)) AS name FROM labelled JOIN symbols USING (id) GROUP BY 1) "
        "SELECT cluster, CASE WHEN (size > 100 OR size > 0.4 * (SELECT count(*) FROM labelled)) AND dirs > 1 THEN parts ELSE dir || '/' || name END AS label FROM t JOIN b USING (cluster)"
    ),
)
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.cluster_labels(t.labels, t.symbols, t.files, _rank(t))


@query("cluster_mismatch", oracle(_DIRS + " SELECT cluster, count(*) AS dirs, CAST(sum(n) - max(n) AS BIGINT) AS mismatch FROM by_dir GROUP BY 1 HAVING count(*) > 1"))
def cluster_mismatch(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.cluster_mismatch(t.labels, t.symbols, t.files)


@query("leak_edges", oracle(" SELECT src, dst, (src * 31 + dst) % 1009 AS betweenness FROM graph JOIN labelled a ON a.id = src JOIN labelled b ON b.id = dst WHERE a.cluster <> b.cluster ORDER BY betweenness DESC, src, dst LIMIT 20"))
def leak_edges(spark: SparkSession, d: str) -> DataFrame:
    """With a given betweenness, as SQL can say it; the operator takes that of graph.betweenness(of_edges=True)."""
    t = Tables(spark, d)
    return V.leak_edges(t.labels, t.graph.withColumn("betweenness", (F.col("src") * 31 + F.col("dst")) % 1009))


@query("adaptive_damping", oracle(SCC + ", z AS (SELECT scc, count(*) AS n FROM sc GROUP BY 1) SELECT round(0.92::DOUBLE - 0.10::DOUBLE * coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 3) AS damping FROM z", recursive=True))
def adaptive_damping(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.adaptive_damping(G.scc(t.symbols, t.graph))


@query("ego_graph", oracle(", und AS (SELECT src, dst FROM graph UNION SELECT dst, src FROM graph), one AS (SELECT min(src) AS c FROM graph), w AS (SELECT c AS id FROM one UNION SELECT u.dst FROM und u, one WHERE u.src = c UNION SELECT v.dst FROM und u JOIN und v ON v.src = u.dst, one WHERE u.src = c) SELECT src, dst FROM graph WHERE src IN (SELECT id FROM w) AND dst IN (SELECT id FROM w)"))
def ego_graph(spark: SparkSession, d: str) -> DataFrame:
    """Two steps around the first symbol that has edges."""
    t = Tables(spark, d)
    return V.ego_graph(t.graph, t.graph.agg(F.min("src").alias("id")))


@query(
    "fan",
    oracle(
        ", e AS (SELECT src, dst, a.file_id AS fs, b.file_id AS fd FROM graph JOIN symbols a ON a.id = src JOIN symbols b ON b.id = dst), i AS (SELECT dst AS id, count(*) AS fan_in, count(DISTINCT CASE WHEN fs <> fd THEN fs END) AS files_in FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS fan_out, count(DISTINCT CASE WHEN fs <> fd THEN fd END) AS files_out FROM e GROUP BY 1) "
        "SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(files_in, 0) AS files_in, coalesce(fan_out, 0) AS fan_out, coalesce(files_out, 0) AS files_out FROM symbols LEFT JOIN i USING (id) LEFT JOIN o USING (id)"
    ),
)
def fan(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.fan(t.graph, t.symbols)


@query("top_exports", oracle(f", r AS (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY {_RANK} DESC, id) AS place FROM symbols WHERE is_exported = 1) SELECT * FROM r WHERE place <= 2"))
def top_exports(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.top_exports(t.symbols, _rank(t))


@query("bisect", oracle(", l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY idx) AS before FROM series) SELECT series, idx, before, value AS after, round(value - before, 2) AS delta, CASE WHEN value = before THEN 'unchanged' WHEN (value > before) = (series <> 'error') THEN 'improved' ELSE 'degraded' END AS direction FROM l WHERE before IS NOT NULL"))
def bisect(spark: SparkSession, d: str) -> DataFrame:
    return V.bisect(Tables(spark, d).series, F.col("series") != "error")


@query("rate_alerts", oracle(", l AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY idx) AS before, row_number() OVER (PARTITION BY series ORDER BY idx DESC) AS r FROM series), x AS (SELECT series, before, value, value > before AS worse FROM l WHERE r = 1 AND before IS NOT NULL) SELECT series, before, value, CASE WHEN before = 0 THEN 'INFO' ELSE 'WARNING' END AS level FROM x WHERE worse AND (before = 0 OR 100 * abs(value - before) / abs(before) > 2)"))
def rate_alerts(spark: SparkSession, d: str) -> DataFrame:
    return V.rate_alerts(Tables(spark, d).series, F.lit(True), 2.0)


@query(
    "forecast_status",
    oracle(
        ", p AS (SELECT a.series, median((b.value - a.value) / (b.idx - a.idx)) AS slope FROM series a JOIN series b ON a.series = b.series AND a.idx < b.idx GROUP BY 1), c AS (SELECT series, max_by(value, idx) AS current, count(*) AS n FROM series GROUP BY 1), m AS (SELECT avg(current) AS m FROM c), "
        "x AS (SELECT series, current, slope, current + 5 * slope AS f, m AS w, 1.5 * m AS k FROM p JOIN c USING (series), m WHERE n >= 4) SELECT series, current, round(slope, 6) AS slope, round(f, 6) AS forecast, CASE WHEN abs(slope) < 0.001 THEN 'stable' WHEN current >= k THEN 'alert' WHEN current >= w THEN 'warning' WHEN f >= k THEN 'alert' WHEN f >= w THEN 'warning' ELSE 'trending' END AS status FROM x"
    ),
)
def forecast_status(spark: SparkSession, d: str) -> DataFrame:
    s = Tables(spark, d).series
    current = s.groupBy("series").agg(F.max_by("value", "idx").alias("current"))
    mean = current.agg(F.avg("current").alias("warning"))
    limits = current.select("series").crossJoin(F.broadcast(mean)).select("series", "warning", (1.5 * F.col("warning")).alias("critical"), F.lit(False).alias("better_up"))  # one row
    out = V.forecast_status(S.theil_sen(s), current, limits, flat=0.001)
    return out.select("series", "current", r6(F.col("slope")).alias("slope"), r6(F.col("forecast")).alias("forecast"), "status")


@query("at_risk", oracle(", h AS (SELECT file_id // 10 AS file_id, CAST(sum(lines_added) AS BIGINT) AS churn FROM changes GROUP BY 1), x AS (SELECT s.id, cc * (1 + coalesce(churn, 0) / CAST((SELECT greatest(max(churn), 1) FROM h) AS DOUBLE)) AS score FROM symbols s JOIN metrics m ON m.symbol_id = s.id LEFT JOIN h ON h.file_id = s.file_id) SELECT id, round(score, 6) AS score FROM x WHERE score >= 10"))
def at_risk(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    churn = t.changes.groupBy(F.expr("file_id div 10").alias("file_id")).agg(F.sum("lines_added").alias("churn"))
    return V.at_risk(t.symbols, t.metrics, churn).withColumn("score", r6(F.col("score")))


@query(
    "span_match",
    oracle(
        ", w AS (SELECT DISTINCT s.name, CASE WHEN s.id % 3 = 0 THEN NULL WHEN s.id % 3 = 1 THEN split_part(path, '/', -1) ELSE 'nowhere.py' END AS file FROM symbols s JOIN files f ON f.id = s.file_id), n AS (SELECT name, count(*) AS n, min(id) AS lone FROM symbols GROUP BY 1), "
        "e AS (SELECT w.name, w.file, count(*) AS m, min(s.id) AS here FROM w JOIN symbols s ON s.name = w.name JOIN files f ON f.id = s.file_id AND ends_with(path, file) GROUP BY 1, 2) "
        "SELECT w.name, w.file, CASE WHEN m = 1 THEN here WHEN n = 1 THEN lone END AS id, CASE WHEN m = 1 THEN 'path' WHEN n = 1 THEN 'name' ELSE 'none' END AS how FROM w LEFT JOIN n ON n.name = w.name LEFT JOIN e ON e.name = w.name AND e.file IS NOT DISTINCT FROM w.file"
    ),
)
def span_match(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    s = t.symbols.join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    file = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.substring_index("path", "/", -1)).otherwise("nowhere.py")
    return V.match_spans(s.select("name", file.alias("file")), t.symbols, t.files)


@query(
    "package_match",
    oracle(
        ", p AS (SELECT DISTINCT name AS package FROM symbols), a AS (SELECT name AS package, id, 0 AS r FROM symbols), b AS (SELECT package, id, 1 AS r FROM (SELECT id, unnest(list_distinct(string_split(qualified, '.'))) AS part FROM symbols) JOIN p ON part = package), "
        "c AS (SELECT a.package, e.src AS id, 2 AS r FROM a JOIN edges e ON e.dst = a.id AND e.kind = 'import'), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT package, id, ['name', 'qualified', 'import'][min(r) + 1] AS how FROM u GROUP BY 1, 2"
    ),
)
def package_match(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.match_packages(t.symbols.select(F.col("name").alias("package")), t.symbols, t.edges)


_REFS = (
    ", sf AS (SELECT s.*, path, dir, regexp_extract(qualified, '^(.*?)(\\.|::)[^.:]*$', 1) AS scope FROM symbols s JOIN files f ON f.id = file_id), refs AS (SELECT src * 1000000 + dst AS ref, t.name, g.kind, s.path AS file, s.dir, s.scope AS parent, CASE WHEN g.kind = 'import' THEN t.dir END AS import_dir FROM edges g JOIN sf s ON s.id = src JOIN sf t ON t.id = dst), "
    "k AS (SELECT ref, c.id, count(*) OVER (PARTITION BY ref, r.kind) AS n, r.kind AS rk, r.name AS rn, c.kind AS ck, c.is_exported AS ex, c.path = file AS pf, c.dir = r.dir AS pd, c.dir IS NOT DISTINCT FROM import_dir AS pi, c.scope = parent AS ps FROM refs r JOIN sf c ON c.name = r.name), "
    "m AS (SELECT *, rk = 'call' AND regexp_matches(rn, '^[A-Z]') AND bool_or(ck = 'class') OVER (PARTITION BY ref, rk) AS make FROM k), "
    "o AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN make THEN CASE WHEN ck = 'class' AND pf THEN 1 WHEN ck = 'class' AND pd THEN 2 WHEN ck = 'class' THEN 3 ELSE 99 END WHEN pf AND ps THEN 4 WHEN pf THEN 5 WHEN pd AND ex = 1 THEN 6 WHEN pd THEN 7 WHEN pi AND ex = 1 THEN 8 WHEN pi THEN 9 WHEN ex = 1 THEN 10 ELSE 11 END AS p FROM m) "
    "SELECT ref, rk AS kind, arg_min(id, struct_pack(p := p, i := id)) AS id, CASE WHEN min(p) = 0 THEN 'alone' WHEN min(p) <= 3 THEN 'class' WHEN min(p) <= 5 THEN 'file' WHEN min(p) <= 7 THEN 'dir' WHEN min(p) <= 9 THEN 'import' WHEN min(p) = 10 THEN 'exported' ELSE 'first' END AS how FROM o GROUP BY 1, 2"
)


@query("best_match", oracle(_REFS))
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as a reference by name from its source; imports know the folder of their target."""
    t = Tables(spark, d)
    s = t.symbols.join(t.files.select(F.col("id").alias("file_id"), "path", "dir").hint("merge"), "file_id")
    a = s.select(F.col("id").alias("src"), F.col("path").alias("file"), "dir", F.regexp_extract("qualified", r"^(.*?)(\.|::)[^.:]*$", 1).alias("parent"))
    b = s.select(F.col("id").alias("dst"), "name", F.col("dir").alias("to_dir"))
    refs = t.edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").select(F.struct((F.col("src") * 1000000 + F.col("dst")).alias("ref"), "kind").alias("ref"), "name", "kind", "file", "dir", "parent", F.when(F.col("kind") == "import", F.col("to_dir")).alias("import_dir"))
    return V.best_match(refs, t.symbols, t.files).select("ref.ref", "ref.kind", "id", "how")


@query(
    "breaking_changes",
    oracle(
        ", o AS (SELECT id || '.' || name AS q, name, kind, file_id, id % 5 AS sig FROM symbols WHERE is_exported = 1), n AS (SELECT id || '.' || nn AS q, nn AS name, kind, file_id, CASE WHEN id % 4 = 0 THEN id % 5 + 1 ELSE id % 5 END AS sig FROM (SELECT *, CASE WHEN id % 3 = 0 THEN name || '_x' ELSE name END AS nn FROM symbols WHERE is_exported = 1 AND id % 7 <> 2)), "
        "j AS (SELECT o.q AS oq, n.q AS nq, o.name AS oname, n.name AS nname, o.kind AS ok, n.kind AS nk, o.file_id AS f1, n.file_id AS f2, o.sig AS s1, n.sig AS s2 FROM o FULL JOIN n ON o.q = n.q), g AS (SELECT * FROM j WHERE nq IS NULL), a AS (SELECT * FROM j WHERE oq IS NULL), "
        "p AS (SELECT g.oq, a.nq, 1 - levenshtein(g.oname, a.nname) / CAST(greatest(length(g.oname), length(a.nname), 1) AS DOUBLE) AS l FROM g JOIN a ON g.f1 = a.f2 AND g.ok = a.nk), r AS (SELECT *, row_number() OVER (PARTITION BY oq ORDER BY l DESC, nq) AS r, row_number() OVER (PARTITION BY nq ORDER BY l DESC, oq) AS q FROM p WHERE l >= 0.6), w AS (SELECT oq, nq FROM r WHERE r = 1 AND q = 1) "
        "SELECT oq AS qualified, 'signature' AS change, NULL AS \"to\" FROM j WHERE s1 <> s2 UNION ALL SELECT g.oq, CASE WHEN w.nq IS NULL THEN 'removed' ELSE 'renamed' END, w.nq FROM g LEFT JOIN w ON w.oq = g.oq"
    ),
)
def breaking_changes(spark: SparkSession, d: str) -> DataFrame:
    """The exported symbols against a later state with some gone, some renamed, some of another signature."""
    s = Tables(spark, d).symbols.filter("is_exported = 1")
    row = lambda name, sig: (F.concat("id", F.lit("."), name).alias("qualified"), name.alias("name"), "kind", "file_id", sig.alias("signature"))
    later = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("_x"))).otherwise(F.col("name"))
    new = s.filter("id % 7 <> 2").select(*row(later, F.when(F.col("id") % 4 == 0, F.col("id") % 5 + 1).otherwise(F.col("id") % 5)))
    return V.breaking(s.select(*row(F.col("name"), F.col("id") % 5)), new)


@query("modification_points", oracle(", u AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1), x AS (SELECT s.id, coalesce(n, 0) AS uses FROM symbols s LEFT JOIN u ON u.id = s.id) SELECT id, uses, CASE WHEN uses = 0 THEN 'safe' WHEN uses >= 3 THEN 'careful' ELSE 'moderate' END AS advice FROM x"))
def modification_points(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.modification_points(t.symbols, t.edges)


@query(
    "test_map",
    oracle(
        ", a AS (SELECT e.dst AS id, count(*) AS direct FROM edges e JOIN symbols s ON s.id = e.src JOIN files f ON f.id = s.file_id WHERE is_test = 1 GROUP BY 1), b AS (SELECT dst AS file_id, count(DISTINCT src) AS importers FROM file_edges JOIN files f ON f.id = src WHERE is_test = 1 GROUP BY 1) "
        "SELECT s.id, coalesce(direct, 0) AS direct, coalesce(importers, 0) AS importers FROM symbols s LEFT JOIN a ON a.id = s.id LEFT JOIN b ON b.file_id = s.file_id"
    ),
)
def test_map(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return V.test_map(t.symbols, t.edges, t.file_edges, t.files)


@query("project_map", oracle(f", x AS (SELECT id, {_RANK} AS rank, greatest(length(qualified) // 4, 1) AS tokens FROM symbols), y AS (SELECT id, tokens, sum(tokens) OVER (ORDER BY rank DESC, id ROWS UNBOUNDED PRECEDING) AS upto FROM x) SELECT id, tokens, CAST(upto AS BIGINT) AS upto FROM y WHERE upto <= 2000"))
def project_map(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that a map of 2,000 tokens holds."""
    t = Tables(spark, d)
    return V.within_budget(t.symbols.join(_rank(t), "id"), "qualified", "rank", 2000)


@query(
    "indentation",
    oracle(
        " SELECT page_id, CASE WHEN len(u) > 0 THEN round(list_sum(u) / len(u) * list_max(u), 2) ELSE 0.0 END AS complexity FROM (SELECT page_id, list_transform(list_filter(regexp_split_to_array(coalesce(html, ''), '\\r\\n|\\n|\\r'), lambda x: regexp_matches(x, '\\S')), lambda x: CAST(length(regexp_extract(x, '^(\\s*)', 1)) - length(replace(regexp_extract(x, '^(\\s*)', 1), chr(9), '')) + length(replace(regexp_extract(x, '^(\\s*)', 1), chr(9), '')) / 4.0 AS DOUBLE)) AS u FROM pages)"
    ),
)
def indentation(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).raw("pages").select("page_id", V.indentation(F.col("html")).alias("complexity"))
