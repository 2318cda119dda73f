"""Each operator on small tables, against brute force, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodegraph.llm import html_text, mixing, near_dedup, neighbours, packing, quality_classifier, quality_rules, sharding, warc
from lodegraph.llm.textstats import with_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _docs():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    out = [(i, "\n".join(say(rng.randint(5, 40)) for _ in range(rng.randint(2, 8))), rng.choice(["en", "de"]), rng.choice(["a", "b", "b", "b"]), 0) for i in range(120)]
    base = out[3][1].split(" ")
    for k in range(12):  # near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"new{k}"
        out.append((200 + k, " ".join(w), "en", "a", 0))
    out += [(300 + k, out[5][1], "en", "b", 0) for k in range(6)]  # exact copies
    junk = " ".join(f"{rng.choice(vocabulary)}{rng.choice('###***$$$')}" for _ in range(90))
    out += [(400, None, "en", "a", 0), (401, "", None, None, 0), (402, " \n\t ", "en", "b", 0), (403, "two words", "en", None, 0), (404, junk, "en", "b", 0), (405, "long " * 9000, "de", "b", 0)]
    out += [out[0], out[0]]  # repeated rows
    return [(i, t, la, s, len(t or "")) for i, t, la, s, _ in out]


DOCS = _docs()


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(DOCS, SCHEMA)
    for name in ("shard", "size", "bucket", "cnt", "score", "component_id", "fine", "target", "taken", "row"):
        d = d.withColumn(name, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_statistics(docs, empty):
    got = {r["doc_id"]: r for r in with_stats(docs, "text", "s_").collect()}
    for i, t, *_ in DOCS:
        w, ls = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cov = {k + j for k in range(len(w) - 2) if c[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        r = got[i]
        assert (r["s_n_words"], r["s_word_chars"], r["s_n_dup_lines"], r["s_n_repeat_words"]) == (len(w), sum(map(len, w)), len(ls) - len(set(ls)), len(cov))
        assert r["s_n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or "")) and r["s_n_distinct"] == len(set(w))
    assert with_stats(empty, "text").count() == 0


def test_long_text_statistics(spark):
    t = " ".join(str(k % 70_000) for k in range(140_000))
    r = with_stats(spark.createDataFrame([(t,)], "text string"), "text").first()
    assert (r["n_words"], r["n_repeat_words"]) == (140_000, 140_000)


def test_sharding(spark, docs, empty):
    d = sharding.with_shards(sharding.with_shards(docs, "doc_id", 4, name="s4"), "doc_id", 5, name="s5")
    rows = d.select("doc_id", "s4", "s5").collect()
    assert all(r["s4"] == r["s5"] or r["s5"] == 4 for r in rows) and len({r["s4"] for r in rows}) == 4
    n = spark.range(20_000)
    share = dict(sharding.with_shards(n, "id", [3.0, 1.0, 0.0]).groupBy("shard").count().collect())
    assert set(share) == {0, 1} and abs(share[0] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("x"), [0.0])
    slots = defaultdict(list)
    for r in sharding.with_slots(d, "s4", ["doc_id"], name="slot").collect():
        slots[r["s4"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sum(map(len, slots.values())) == len(DOCS)
    assert sharding.with_slots(sharding.with_shards(empty, "doc_id", 3), "shard", ["doc_id"]).count() == 0
    nulls = spark.createDataFrame([(None,), (None,), (1,)], "doc_id long")
    assert len({r["shard"] for r in sharding.with_shards(nulls.filter("doc_id IS NULL"), "doc_id", 16).collect()}) == 1


def test_write_shards(spark, docs, tmp_path):
    path = sharding.write_shards(docs.drop("shard"), "doc_id", 3, str(tmp_path / "s"), files_per_shard=2)
    back = spark.read.parquet(path)
    assert back.count() == len(DOCS) and back.select("shard").distinct().count() == 3


def _targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, left = share * sum(sizes.values()), {}, set(sizes)
    while left:
        rest = total - sum(out.values())
        full = [s for s in left if w[s] * rest / sum(w[x] for x in left) > most * sizes[s]]
        if not full:
            return out | {s: w[s] * rest / sum(w[x] for x in left) for s in left}
        for s in full:
            out[s] = most * sizes[s]
        left -= set(full)
    return out


def test_mixing(docs, empty):
    d = docs.withColumn("words", mixing.word_count(F.col("text")))
    m, c = mixing.with_mix(d, "doc_id", "words", "source")
    rows = m.select("doc_id", "source", "words", c["target"], c["taken"], c["source_size"]).collect()
    again = m.select("doc_id", "source", "words", c["target"], c["taken"], c["source_size"]).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == len(DOCS)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["words"]
        taken[r["source"]] += r[c["taken"]]
        assert 0 <= r[c["taken"]] <= 2 * r["words"]
    want = _targets(dict(sizes))
    for r in rows:
        assert r[c["target"]] == pytest.approx(want[r["source"]]) and r[c["source_size"]] == sizes[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 3 * mixing.BLOCK for s in sizes)
    assert mixing.mixed_texts(empty).count() == 0


def test_mixed_texts(spark):
    d = spark.createDataFrame(DOCS, SCHEMA).dropDuplicates(["doc_id"])
    m, c = mixing.with_mix(d.withColumn("words", mixing.word_count(F.col("text"))), "doc_id", "words", "source")
    want = {r["doc_id"]: r[c["taken"]] for r in m.collect()}
    got = Counter()
    texts = {i: t for i, t, *_ in DOCS}
    for r in mixing.mixed_texts(d).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(WORD.findall(r["text"])) <= set(WORD.findall(texts[r["doc_id"]]))
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_sainte_lague(spark):
    votes = [53, 24, 23, 0, 7]
    d = spark.createDataFrame([(k, v, 11) for k, v in enumerate(votes)], "party long, votes long, seats long")
    got = {r["party"]: r["n"] for r in mixing.sainte_lague(d, [], "party", "votes", "seats", "n").collect()}
    want = Counter()
    for _ in range(11):
        want[max(range(5), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
    assert got == {k: want[k] for k in range(5)}


def test_quality_rules(spark, docs, empty):
    d = docs.select(*SCHEMA_COLS, "row")
    got = quality_rules.filtered(d)
    assert got.columns == d.columns
    ids = {r["doc_id"] for r in got.collect()}
    long = {i for i, t, *_ in DOCS if len(WORD.findall(t or "")) >= 50}
    assert ids <= long and 404 not in ids and 405 not in ids
    assert len(long - ids - {404, 405}) <= 2
    assert quality_rules.filtered(empty).count() == 0


SCHEMA_COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_core_estimate_resists_outliers(spark):
    """Against numpy: the final estimate's distances equal those of the core's own mean and covariance."""
    rng = np.random.default_rng(3)
    rows = [("en", "s", 100 + int(rng.integers(0, 50)), 500 + int(rng.integers(0, 60)) * 4, int(rng.integers(0, 4)), 0, int(rng.integers(0, 10)), int(rng.integers(5, 25)), 10) for _ in range(400)]
    rows += [("en", "s", 100, 900, 300, 0, 0, 400, 10)] * 60
    d = spark.createDataFrame(rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_lines long")
    keys, est = quality_rules.fit(d)
    got = quality_rules.judged(d, keys, est).collect()
    assert all(not r["kept"] for r in got if r["n_symbols"] == 300) and all(r["kept"] for r in got if r["n_symbols"] < 300)
    assert [r["d2"] for r in quality_rules.judged(d, *quality_rules.fit(d.repartition(3))).orderBy("d2").collect()] == [r["d2"] for r in quality_rules.judged(d, keys, est).orderBy("d2").collect()]


def test_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0 if i == 404 else 1, 0) for i, *_ in DOCS] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.scored(docs, quality_classifier.learn(docs, labels), "s").collect()
    assert len(out) == len(DOCS) and all(0 <= r["s"] <= 1 for r in out)
    assert quality_classifier.accepted(empty, labels).count() == 0
    none = quality_classifier.learn(docs, labels.limit(0))
    assert {r["s"] for r in quality_classifier.scored(docs, none, "s").collect()} == {0.5}
    held = {i for i, *_ in DOCS if zlib.crc32(str(i).encode()) % 5 == 0}
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert held and quality_classifier.learn(docs, flipped) == quality_classifier.learn(docs, labels)


def _brute(rows, width, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(near_dedup._LOWER).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(docs, empty):
    got = near_dedup.near_duplicates(docs, width=4).collect()
    assert len(got) == len(DOCS)
    want = _brute(DOCS, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert near_dedup.near_duplicates(empty).count() == 0


def test_deduplicated(docs):
    out = near_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    want = {i for i, (_, c) in _brute(DOCS, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in out.collect()} == want


def test_near_duplicates_without_ids(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(d).collect()} == {(None, None), (1, 1), (2, 1)}


def test_packing(docs, empty):
    found = packing.pieces(docs, size=64, keep_ids=True)
    rows = packing.packed(found, size=64).collect()
    enc = packing.encoder(packing.vocabulary())
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4
    for s in seqs.values():
        end = 0
        for at, n in sorted(s):
            assert at == end
            end += n
        assert end <= 64
    for i, t, *_ in DOCS[1:]:
        if i:
            whole = (enc.whole(t) if t else b"") + (1).to_bytes(4, "little")
            parts = sorted(by[i], key=lambda r: r["piece"])
            assert b"".join(bytes(r["ids"]) for r in parts) == whole and [r["start"] for r in parts] == [64 * k for k in range(len(parts))]
    total = sum(r["length"] for r in rows)
    assert len(seqs) <= -(-total // 64) + 1
    assert packing.packed(packing.pieces(empty)).count() == 0
    joined = packing.sequences(packing.packed(found, size=64)).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * total


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 200
    pages = [(5, "u", big), (3, "v", big), (3, "v", big), (9, None, "tiny"), (8, "w", "tiny"), (1, "z\r\nq", None), (2, "y", "é" * 60), (None, "n", big)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    manifest = warc.write_warc(d, path, roll=300, partitions=2)
    names = [r["name"] for r in manifest.collect()]
    assert len(names) > 2 and not [f for f in os.listdir(path) if f.startswith("_temporary")]
    again = warc.write_warc(d, str(tmp_path / "w2"), roll=300, partitions=2)
    assert sorted(map(tuple, manifest.collect())) == sorted(map(tuple, again.collect()))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(manifest, path).collect()), key=str)
    dig = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(5, 203, dig(big), "revisit", 3), (3, 203, dig(big), "response", None), (3, 203, dig(big), "revisit", 3), (9, 4, dig("tiny"), "response", None), (8, 4, dig("tiny"), "response", None), (1, 0, dig(""), "response", None), (2, 120, dig("é" * 60), "response", None), (None, 203, dig(big), "revisit", 3)]
    assert got == sorted(want, key=str)
    none = warc.write_warc(d.limit(0), str(tmp_path / "e"), partitions=2)
    assert none.count() == 0 and warc.read_warc(none, str(tmp_path / "e")).count() == 0


def test_html(spark):
    body = lambda k: f"<html><body><div class='m{k}'>Menu</div><div class='c'><p>Words of page {k} go here.<p>And a second part.</div>"
    pages = [(k, f"http://h.org/{k}", body(k)) for k in range(6)] + [(6, None, None), (7, "http://h.org/x", ""), (8, "bad url", "<p>only this"), (0, "http://h.org/0", body(0))]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extracted(d).collect())
    text = lambda k: f"Words of page {k} go here. And a second part."
    assert got == sorted([(k, text(k), len(text(k))) for k in (0, 0, 1, 2, 3, 4, 5)] + [(6, "", 0), (7, "", 0), (8, "only this", 9)])
    assert html_text.extracted(d.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 6)).round(2)
    rows = [(k, [float(v) for v in x[k]]) for k in range(300)]
    rows += [(1000 + k, rows[7][1]) for k in range(30)] + [(1020, rows[7][1])]  # copies, one repeated
    rows += [(500, None), (520, [0.0] * 6), (540, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (560, [float("nan")] * 6), (580, [1.0, 2.0]), (None, rows[0][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(list)
    for r in neighbours.nearest(d, k=5, confidence=0.999999).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)}
    for q in [i for i in good if i % 20 == 0]:
        want = sorted(((-(good[q] * v).sum(), i) for i, v in good.items() if i != q))[:5]
        mine = sorted(got[q])
        assert [i for _, i, _ in mine] == [i for _, i in want] and [s for *_, s in mine] == pytest.approx([-s for s, _ in want])
    assert set(got) == {i for i in good if i % 20 == 0}
    assert neighbours.nearest(d.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_several_texts(spark):
    """An id has the links of each of its texts, and joins them."""
    rng = random.Random(11)
    a, b = ([f"{p}{rng.randrange(9999)}" for _ in range(60)] for p in "ab")
    text = lambda w, more="": " ".join(w) + more
    find = lambda rows: {(r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert find([(5, text(a)), (5, text(b)), (11, text(a, " x")), (12, text(b, " y"))]) == {(5, 5), (11, 5), (12, 5)}
    assert find([(5, text(a)), (7, text(a)), (7, text(b)), (9, text(b)), (7, None)]) == {(5, 5), (7, 5), (9, 5)}


def test_near_duplicates_of_long_texts(spark):
    rng = random.Random(12)
    w = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:-3000])), (3, " ".join(w[:30_000])), (4, "long " * 200_000)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


@pytest.mark.parametrize("spread", [64, 3])
def test_template_groups_close_in_blocks(spark, monkeypatch, spread):
    """Copies of one template, some linked only in chains, some not at all; hot keys split and blocks of few rows."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(13)
    base = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(70):
        w = list(base)
        for _ in range(rng.choice([2, 4, 6, 8, 10])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), None, None, 0))
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    keys = near_dedup._keys
    monkeypatch.setattr(near_dedup, "SPREAD", spread)
    seen = pd.concat(list(near_dedup._described(4)(iter([pd.DataFrame([r[:2] for r in rows])]))))
    split = pd.concat(list(keys(iter([seen.assign(cls=seen["id"])]))))
    assert len(split) == 70 * 96 and (spread == 64 or split["origin"].notna().any())
    monkeypatch.setattr(near_dedup, "_keys", lambda b: _spread_keys(b, spread, keys))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(d, width=4).collect()}
    assert got == _brute(rows, 4, 80)


def _spread_keys(batches, spread, keys):
    near_dedup.SPREAD = spread  # in the worker's own copy of the module
    yield from keys(batches)


def test_warc_of_long_and_repeated_records(spark, tmp_path):
    """A payload of 20 MB, and small equal payloads under one key or none: every record has an id of its own."""
    pages = [(1, "u", "long text " * 2_000_000), (2, "v", "tiny"), (2, "v", "tiny"), (None, "w", "tiny"), (None, "w", "tiny")]
    path = str(tmp_path / "w")
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "_temporary-lost").write_text("left by a lost attempt")
    manifest = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    assert not [f for f in os.listdir(path) if f.startswith("_temporary")]
    ids = []
    for r in manifest.collect():
        with open(f"{path}/{r['name']}", "rb") as f:
            ids += [h["WARC-Record-ID"] for h, _ in warc.records(f)]
    assert len(ids) == len(set(ids)) == 5
    assert sorted(r["payload_bytes"] for r in warc.read_warc(manifest, path).collect()) == [4, 4, 4, 4, 20_000_000]
