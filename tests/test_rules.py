from pyspark.sql import functions as F

from lodegraph.operators import composite as C
from lodegraph.operators import detect as D
from lodegraph.operators import links as L
from lodegraph.operators import relational as R
from lodegraph.operators import text as T
from lodegraph.operators import whatif as W


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_detectors_cover_the_catalogue():
    tasks = [x.task for x in D.DETECTORS]
    assert len(tasks) == len(set(tasks)) == 19 and len(D.OTHER_TASKS) == 4


def test_auth_gaps(spark):
    body = ["Route::get('/open', X)", "Route::group(['middleware' => 'auth'], function () {", "Route::get('/in', X)", "});", "Route::post('/after', X)", "Route::get('/own', X)->middleware('auth')", "Route::get('/public/x', X)"]
    d = spark.createDataFrame([("r.php", k, b) for k, b in enumerate(body)], "file string, line long, body string")
    assert rows(L.auth_gaps(d), "route") == {("/open",), ("/after",)}


def test_migration_safety(spark):
    body = ["create table a (", "-- if not exists guard", "create table b (", "drop table c", "alter table d drop column e"]
    d = spark.createDataFrame([("m.sql", k, b) for k, b in enumerate(body)], "file string, line long, body string")
    assert rows(L.migration_safety(d), "line", "level", "what") == {(0, "high", "create"), (4, "medium", "drop-column")}


def test_missing_index(spark):
    q = spark.createDataFrame([("t", ["a", "b", "id"], 1), ("t", ["a"], 0), ("u", ["x"], 0), ("t", ["created_at"], 0)], "table string, columns array<string>, paginated int")
    i = spark.createDataFrame([("t", ["a", "c"])], "table string, columns array<string>")
    assert rows(L.missing_index(q, i), "table", "columns", "level") == {("t", "a,b", "high"), ("u", "x", "medium")}


def test_bridges_and_conventions(spark):
    p = spark.createDataFrame([(1, "User", "message"), (2, "Search", "service")], "id long, name string, kind string")
    s = spark.createDataFrame([(10, "user"), (11, "SearchClient"), (12, "search_stub"), (13, "other")], "id long, name string")
    assert rows(L.protobuf_bridge(p, s), "proto_id", "symbol_id", "link") == {(1, 10, "message"), (2, 11, "service"), (2, 12, "service")}
    f = spark.createDataFrame([(1, "src/a.py"), (2, "tests/test_a.py"), (3, "b.go"), (4, "b_test.go"), (5, "c.txt")], "id long, path string")
    assert rows(L.convention_tests(f), "id", "test_id") == {(1, 2), (3, 4)}
    t = spark.createDataFrame([(1, "<b>{{ user }} {{other.x}} {{ none }}")], "id long, text string")
    assert rows(L.template_bridge(t, s), "symbol_id") == {(10,), (13,)}


def test_drift_and_health(spark):
    b = spark.createDataFrame([("M", "first_name"), ("M", "age"), ("N", "x")], "model string, field string")
    f = spark.createDataFrame([("M", "firstName"), ("M", "extra")], "model string, field string")
    assert rows(L.api_drift(b, f), "field", "level") == {("age", "medium"), ("extra", "high")}
    snaps = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 70.0), ("b", 1, 90.0)], "repo string, ts long, score double")
    assert tuple(L.workspace_health(snaps, spark.range(25)).first()) == (80.0, 2, 25, "moderate")


def test_whatif(spark):
    s = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "id long, file_id long")
    e = spark.createDataFrame([(1, 2, "call"), (2, 3, "call"), (2, 3, "import")], "src long, dst long, kind string")
    assert rows(W.file_graph(s, e), "src", "dst", "symbol_count") == {(10, 20, 2)}
    moved = W.move(s, spark.createDataFrame([(2, 20)], "id long, to_file long"))
    assert rows(W.file_graph(moved, e), "src", "dst", "symbol_count") == {(10, 20, 1)}
    s2, e2 = W.delete(s, e, spark.createDataFrame([(3,)], "id long"))
    assert tuple(W.graph_metrics(s2, e2).first()) == (2, 1, 0, 1)
    old, new = spark.createDataFrame([("a", 1.0, "h"), ("b", 1.0, "h"), ("c", 1.0, "h")], "path string, mtime double, hash string"), spark.createDataFrame([("a", 1.0005, "z"), ("b", 2.0, "z"), ("d", 1.0, "h")], "path string, mtime double, hash string")
    assert rows(W.incremental(old, new), "path", "status") == {("b", "modified"), ("c", "removed"), ("d", "added")}


def test_rules(spark):
    f = spark.createDataFrame([(1, "src/ui/a.py", 0), (2, "src/db/b.py", 0), (3, "tests/t.py", 1)], "id long, path string, is_test int")
    e = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    assert rows(D.rule_dependency(e, f, "src/ui/**", "src/db/**"), "id", "detail") == {(1, "src/ui/a.py -> src/db/b.py")}
    assert rows(D.gate_tests(f, e, 1), "id") == {(1,)}
    assert rows(D.rule_paths(f, "src/**", ["src/db/*"]), "id") == {(1,)}


def test_resolve_prefers_qualified_then_references(spark):
    s = spark.createDataFrame([(1, "f", "a.f"), (2, "f", "b.f"), (3, "F", "c.F")], "id long, name string, qualified string")
    deg = spark.createDataFrame([(2, 5)], "id long, in_degree long")
    refs = spark.createDataFrame([("a.f",), ("f",), ("F",), ("none",)], "ref string")
    assert rows(R.resolve(refs, s, deg), "ref", "id") == {("a.f", 1), ("f", 2), ("F", 3)}


def test_text(spark):
    d = spark.createDataFrame([(1, "HTTPServer runs parseURL quickly"), (2, None), (3, "servers running")], "doc long, text string")
    assert rows(T.tokens(d, "doc", "text"), "t") == {("http",), ("serv",), ("run",), ("parse",), ("url",), ("quick",), ("server",), ("runn",)}
    u = spark.createDataFrame([("https://A.b/En/12.html?x#y",), ("/en/7/",)], "u string").select(T.url_template(F.col("u")))
    assert [r[0] for r in u.collect()] == ["/en/{}", "/en/{}"]


def test_partition_and_severity(spark):
    one = lambda *xs: spark.range(1).select(C.preflight(*map(F.lit, xs))).first()[0]
    assert [one(0, 1, 1), one(0, 1, 0), one(4, 1, 1), one(12, 20, 1), one(0, 50, 1)] == ["OK", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    v = spark.range(12)
    e = spark.createDataFrame([(k, k + 1) for k in range(0, 12, 2)], "src long, dst long")
    sizes = [r["count"] for r in C.partition(v, e, 3).groupBy("part").count().collect()]
    assert sum(sizes) == 12 and max(sizes) - min(sizes) <= 2


def test_counts_in_place_equal_counts_by_shuffle(spark):
    """Rows are counted where they are read; an id that comes twice is counted over all of its rows."""
    texts = ["parseURLQuick HTTPServer servers served the THE", "ABCd aBcD a1B2c x", "Kelvin İstanbul naïve cafés", None, "", "running RUNNING runningRunning", "a.b,c;dd"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    plan = T.counted(d, "doc", "text")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    want = {tuple(r) for r in T.term_counts(T.tokens(d, "doc", "text")).collect()}
    most = {}
    for doc, _, n in want:
        most[doc] = max(n, most.get(doc, 0))
    assert {tuple(r) for r in plan.collect()} == {(doc, t, n, most[doc]) for doc, t, n in want}
    twice = spark.createDataFrame([(1, "car"), (1, "cars bus"), (2, "car")], "doc long, text string")
    assert {tuple(r) for r in T.counted(twice, "doc", "text").collect()} == {(1, "car", 2, 2), (1, "bus", 1, 2), (2, "car", 1, 1)}
