"""Rendezvous hashing against the same law in Python over all documents."""

import os
import zlib

import pandas as pd
import pytest
import xxhash

from lodegraph.llm import sharding

DATA = "/root/testdata/sf0.01"


def by_hand(key, shards):
    """The shard of largest draw; xxHash64 chained over the key's text, the seed and the shard's number, as Spark does."""

    def draw(j):
        h = xxhash.xxh64_intdigest(("\x00null" if key is None else str(key)).encode(), 42)
        for n in (0, j):
            h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h)
        return h % (1 << 52)

    return max(range(shards), key=lambda j: (draw(j), -j))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_all_documents_by_hand(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    got = sharding.op3_rendezvous_sharding(spark, DATA).toPandas()
    assert len(got) == len(docs) and set(got["law"]) == {"key"}
    text = {i: (t or "").encode() if isinstance(t, str) else b"" for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    for r in got.itertuples():
        assert (r.shard, r.grown_shard) == (by_hand(r.doc_id, 16), by_hand(r.doc_id, 17))
        assert (r.size, r.text_crc32) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_slots_of_equal_rows_spread(spark):
    """10,000 rows that are all alike: every hash bucket numbers some of them."""
    d = spark.range(10_000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS shard")
    slots = sharding.with_slots(d, "shard", ["doc_id"])
    assert sorted(r["slot"] for r in slots.collect()) == list(range(10_000))
