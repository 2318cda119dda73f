import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodegraph.llm import packing, quality_classifier, quality_rules
from lodegraph.llm.common import staged
from lodegraph.llm.registry import ORACLE_SQL, QUERIES
from lodegraph.llm.textstats import with_stats

DATA = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "minhash_near_dedup", "source_mixing", "best_fit_packing"]


def _survivors(rows, width=5, percent=80):
    """Smallest id of each component of pairs that are alike, by comparing all pairs of sets."""
    sets = {}
    for i, t in rows.items():
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\x1c", "\x00").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {i for i in sets if find(i) == i}


@pytest.mark.skipif(not os.path.isdir(DATA) or "SLOW_TESTS" not in os.environ, reason="takes minutes: set SLOW_TESTS")
def test_stages_against_brute_force(spark, tmp_path):
    """What each stage keeps, against the decision made anew on its own input; texts pass unchanged until the mix."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
    texts = [{r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in inputs]
    for before, after in ((0, 1), (1, 2), (2, 3)):
        assert texts[after].items() <= texts[before].items()

    model = quality_classifier.learn(inputs[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    names = list(quality_classifier.features())
    stats = with_stats(inputs[0], "text", "s_").select("doc_id", *[c.alias(n) for n, c in quality_classifier.features("s_").items()]).toPandas()
    assert set(texts[1]) == set(stats["doc_id"][model.score(stats[names].to_numpy(dtype=float)) >= quality_classifier.THRESHOLD])

    stats = staged(with_stats(inputs[1], "text").drop("text"), "stats")
    assert set(texts[2]) == {r["doc_id"] for r in quality_rules.judged(stats, *quality_rules.fit(stats)).filter("kept").collect()}
    assert not [i for i in texts[2] if len((texts[1][i] or "").split()) < 50]

    assert set(texts[3]) == _survivors(texts[2])

    mixed = Counter()
    for r in inputs[4].select("doc_id", "text").collect():
        mixed[r["doc_id"]] += len(r["text"].split())
        assert set(r["text"].split()) <= set(texts[3][r["doc_id"]].split())
    assert all(n <= 2 * len(texts[3][i].split()) for i, n in mixed.items())

    enc, seqs, placed = packing.encoder(packing.vocabulary()), defaultdict(list), Counter()
    for r in docs.collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        placed[r["doc_id"]] += r["length"]
    want = Counter()
    for r in inputs[4].select("doc_id", "text").collect():
        want[r["doc_id"]] += len(enc.whole(r["text"])) // 4 + 1
    assert placed == want
    for s in seqs.values():
        ends = [0, *[at + n for at, n in sorted(s)]]
        assert [at for at, _ in sorted(s)] == ends[:-1] and ends[-1] <= packing.SIZE


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            assert 0 < docs.count() <= before
            before = docs.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
