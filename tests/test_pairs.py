"""Joins whose output is larger than their input by far."""

from lodegraph.functions import pairs
from lodegraph.operators import links as L
from lodegraph.operators import text as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_pairs_of_a_frequent_key_are_dealt_out(spark, monkeypatch):
    """All pairs of 40 rows of one name, in lists of 7: they lay in one or two tasks, as their input is small."""
    monkeypatch.setattr(pairs, "A_LIST", 7)
    ids = [(k, "Name", "service") for k in range(40)] + [(None, "name", "message"), (99, None, "message")]
    protos, symbols = spark.createDataFrame(ids, "id long, name string, kind string"), spark.createDataFrame([(k, "nAME") for k in range(40)] + [(50, "name_stub")], "id long, name string")
    got = L.protobuf_bridge(protos, symbols)
    assert got.rdd.getNumPartitions() >= 8
    assert rows(got) == sorted([(p, s, "message") for p in [*range(40), None] for s in range(40)] + [(p, 50, "service") for p in range(40)], key=str)
    routes = spark.createDataFrame([(k, "/a/{}") for k in range(20)] + [(3, "/a/{}"), (30, None)], "route_id long, template string")
    calls = routes.withColumnRenamed("route_id", "call_id")
    got = T.url_match(routes, calls)
    assert got.rdd.getNumPartitions() >= 8 and rows(got) == sorted([(a, b) for a in [*range(20), 3] for b in [*range(20), 3]], key=str)


def test_config_bridge_takes_the_best_of_each_pair(spark, monkeypatch):
    monkeypatch.setattr(pairs, "A_LIST", 2)
    keys = spark.createDataFrame([(1, "db"), (1, "DB"), (2, "db"), (3, "Db"), (4, "a.b"), (5, "db"), (5, "db"), (6, None)], "id long, key string")
    uses = spark.createDataFrame([(10, "db"), (11, "DB.host"), (12, "db.host"), (13, "A.B"), (14, "db"), (14, "dB"), (15, None), (16, "a.b.c")], "id long, key string")
    got = L.config_bridge(keys, uses)
    assert got.rdd.getNumPartitions() >= 8
    want = {}
    for k, key in keys.collect():
        for u, used in uses.collect():
            if key is not None and used is not None:
                p = 1.0 if key == used else 0.9 if key.lower() == used.lower() else 0.85 if "." in used and key == used.split(".")[0] else 0
                want[k, u] = max(p, want.get((k, u), 0))
    assert rows(got) == sorted([(*k, p) for k, p in want.items() if p], key=str)
