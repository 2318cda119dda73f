import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodegraph.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["cochange_pairs", "dark_matter", "bus_factor", "ownership_dir", "resolve_symbol", "debt_scores", "file_health", "modified_z", "scc", "detect_all", "tfidf_search", "events_session"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", SOME)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in "part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel = con.sql(registry.ORACLE_SQL[name])
    cols = sorted(rel.columns)
    norm = lambda rows, names: sorted(tuple(round(float(x), 5) if isinstance(x, float) else str(x) for _, x in sorted(zip(names, r, strict=True))) for r in rows)
    df = registry.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == cols
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(rel.fetchall(), rel.columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_entry(spark):
    assert entry.entry(spark).columns == ["file_id_a", "file_id_b", "cochange_count", "npmi", "lift", "strength"]
