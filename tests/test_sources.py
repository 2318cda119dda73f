import json

import pytest

from lodegraph.sources import ingest, sinks
from lodegraph.streaming import events as E


def test_change_log(spark):
    text = ["COMMIT:abc|Ann|100|a|b", "", "3\t1\tsrc/{old => new}/f.py", "-\t-\timg.png", "COMMIT:def|Bo|200|fix", "5\t0\ta.py => b.py"]
    d = ingest.change_log(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
    assert {(r["hash"], r["author"], r["ts"], r["message"], r["path"], r["added"], r["removed"]) for r in d.collect()} == {
        ("abc", "Ann", 100, "a|b", "src/new/f.py", 3, 1),
        ("abc", "Ann", 100, "a|b", "img.png", 0, 0),
        ("def", "Bo", 200, "fix", "b.py", 5, 0),
    }


def test_blame(spark):
    h = "a" * 40
    text = [f"{h} 1 1 1", "author Ann", "author-time 77", "\tx = 1"]
    assert [tuple(r) for r in ingest.blame(spark.createDataFrame(list(enumerate(text)), "line long, value string")).collect()] == [(h, "Ann", 77, "x = 1")]


def _read(spark, tmp_path, data):
    p = tmp_path / "r.json"
    p.write_text(json.dumps(data))
    return spark.read.option("multiLine", "true").json(str(p))


def test_traces(spark, tmp_path):
    span = lambda n, a, b, c: {"name": n, "startTimeUnixNano": a, "endTimeUnixNano": b, "status": {"code": c}}
    d = _read(spark, tmp_path, {"resourceSpans": [{"scopeSpans": [{"spans": [span("f", "0", "1000000", 0), span("f", "0", "3000000", 2)]}]}]})
    assert tuple(ingest.otel(d).first()) == ("f", 2, 2.0, pytest.approx(2.98), 0.5)
    assert ingest.sniff_trace(d.columns) == "otel"
    d = _read(spark, tmp_path, [{"traceId": "1", "name": "g", "duration": 4000, "tags": {"error": "x"}}])
    assert tuple(ingest.zipkin(d).first()) == ("g", 1, 4.0, 4.0, 1.0)
    d = _read(spark, tmp_path, {"data": [{"spans": [{"operationName": "h", "duration": 2000, "tags": [{"key": "error", "value": "true"}]}]}]})
    assert tuple(ingest.jaeger(d).first()) == ("h", 1, 2.0, 2.0, 1.0)


def test_vulnerabilities(spark, tmp_path):
    d = _read(spark, tmp_path, {"Results": [{"Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "Severity": "HIGH", "Title": "t"}]}]})
    assert tuple(ingest.vulnerabilities(d, "trivy").first()) == ("CVE-1", "p", "high", "t", "trivy")
    d = _read(spark, tmp_path, {"dependencies": [{"name": "q", "vulns": [{"id": "PYSEC-1", "description": "d"}]}]})
    assert tuple(ingest.vulnerabilities(d, "pip").first()) == ("PYSEC-1", "q", "unknown", "d", "pip")


def test_python_symbols(spark):
    src = 'class A(B):\n    """Doc."""\n    def m(self):\n        return helper()\n\ndef helper():\n    import os\n'
    d = spark.createDataFrame([("a.py", src), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    assert {(r["qualified"], r["kind"], r["line_start"]) for r in ingest.python_symbols(d).collect()} == {("A", "class", 1), ("A.m", "method", 3), ("helper", "function", 6)}
    assert {(r["source"], r["target"], r["kind"]) for r in ingest.python_references(d).collect()} == {("A", "B", "inherits"), ("A.m", "helper", "call"), ("helper", "os", "import")}


def test_files(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests" / "test_a.py").write_text("x\ny\n")
    (tmp_path / "b.js").write_text("// generated by tool\n")
    got = {r["path"].split("/")[-1]: (r["language"], r["role"], r["line_count"]) for r in ingest.files(spark, str(tmp_path)).collect()}
    assert got == {"test_a.py": ("python", "test", 2), "b.js": ("javascript", "generated", 1)}


def test_sinks(spark):
    v = spark.createDataFrame([("r", 1, "bad")], "rule string, id long, detail string")
    doc = json.loads(sinks.sarif_document([r["result"] for r in sinks.sarif(v, "t").collect()], "t"))
    assert doc["runs"][0]["results"][0]["ruleId"] == "r"
    e = json.loads(sinks.envelope("x", {"n": 1}, v, as_of="2024", limit=0))
    assert e["results"] == [] and e["summary"]["truncated"]
    a, b = v.union(v.selectExpr("'s'", "2", "'d'")), v.selectExpr("'s' AS rule", "2 AS id", "'d' AS detail").union(v)
    assert sinks.evidence_hash(a).first()[0] == sinks.evidence_hash(b).first()[0] != sinks.evidence_hash(v).first()[0]
    assert [r["line"] for r in sinks.tsv(v).collect()] == ["r\t1\tbad"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10) AS ts, 'a' AS event_type, 1.0D AS value, id % 2 AS user_id FROM range(24)").write.parquet(src)
    E.run_once(spark, src, lambda d: E.tumbling(d), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = {(r["start"], r["n"]) for r in E.tumbling(spark.read.parquet(src)).collect()}
    got = {(r["start"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= batch
    up = str(tmp_path / "up")
    spark.createDataFrame([("f", "otel", 1, 0.5, 1), ("f", "otel", 9, 0.1, 2)], "name string, trace_source string, call_count long, error_rate double, seen long").write.parquet(up)
    E.merge_runtime(spark, up, str(tmp_path / "t"), str(tmp_path / "cp2"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t-0")).collect()] == [("f", "otel", 9, 0.1, 2)]
