import itertools
import random

from pyspark.sql import functions as F

from lodegraph.llm import licenses as L


def _brute(text):
    """Every unit against every template, without bounds."""
    lines = (text or "").split("\n")
    known = frozenset().union(*(L.pairs(L.normalised(t)) for _, t in L.TEMPLATES))
    units = [(k, k) for k in range(len(lines))]
    real = [k for k, x in enumerate(lines) if L.normalised(x)]
    for hit, group in itertools.groupby(real, key=lambda k: not L.pairs(L.normalised(lines[k])).isdisjoint(known)):
        group = list(group)
        if hit and len(group) > 1:
            units.append((group[0], group[-1]))
    if len(lines) > 1:
        units.append((0, len(lines) - 1))
    found = []
    for a, b in units:
        unit = L.pairs(L.normalised("\n".join(lines[a : b + 1])))
        best = max(((L.dice(unit, p), len(p), n) for n, t in L.TEMPLATES if (p := L.pairs(L.normalised(t)))), key=lambda x: (x[0], x[1]), default=(0, 0, ""))
        if unit and best[0] >= L.THRESHOLD:
            found.append((a, b, round(best[0], 9)))
    return sorted(found)


TEXTS = [
    None, "", " \n ", "nothing here", "Released under the MIT License.", "prose before\nLicensed under the  APACHE license, version 2.0\nprose after it",
    L._MIT, L._MIT.replace(". ", ".\n").replace("Permission", "permission"), "Title line of something\n" + L._ISC, "All rights reserved.\nAll rights reserved.",
    "This work is licensed under the GNU General Public License, version 2.", L._GPL.format(3) + "\n" + "word " * 3000, "Licensed under the MIT Licence!\nLicensed under CC BY-NC 4.0.",
]


def test_matches_equal_brute_force():
    s = L.Scanner()
    for t in TEXTS:
        assert sorted((m.first, m.last, round(m.score, 9)) for m in s.matches(t)) == _brute(t), t


def test_scan(spark):
    d = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, TEXTS[4])], "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = [(r["doc_id"], r["license"], r["n_matches"]) for r in L.scanned(d).collect()]
    by = {i: (n, m) for i, n, m in got}
    assert len(got) == len(TEXTS) + 2
    assert [by[k][0] for k in range(len(TEXTS))] == [None, None, None, None, "MIT", "Apache-2.0", "MIT", "MIT", "ISC", "all-rights-reserved", "GPL-2.0", "GPL-3.0", "CC-BY-NC-4.0"]
    assert by[None] == ("MIT", 1) and got.count((4, "MIT", 1)) == 2
    assert L.scanned(d.limit(0)).count() == 0


def _brute_windows(text, templates):
    """The greatest (score, size, name) of all stretches of words, without bounds."""
    words, best = L.normalised(text), (0, 0, "")
    for i, j in itertools.combinations(range(len(words) + 1), 2):
        unit = L.pairs(words[i:j])
        best = min([best, *((-L.dice(unit, p), -len(p), n) for n, p in templates)])
    return best


def test_windows_equal_brute_force():
    rng = random.Random(2)
    short = [(n, t) for n, t in L.TEMPLATES if len(t) < 90]
    compiled = [(n, L.pairs(L.normalised(t))) for n, t in short]
    s = L.Scanner(short)
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 4)):
            words += rng.choices("the license of under rights public gnu mit word".split(), k=rng.randrange(6)) + [w for w in L.normalised(rng.choice(short)[1]) if rng.random() > 0.08]
        text = "".join(w + rng.choice("  \n") for w in words)
        want = _brute_windows(text, compiled)
        found = [(-m.score, -m.size, m.licence) for m in s.everything(text)]
        assert min(found, default=(0, 0, "")) == (want if -want[0] >= L.THRESHOLD else (0, 0, "")), text


def test_notices_inside_prose(spark):
    prose = "Some of the words in the text of the page go to the reader. "
    texts = ["Copyright 2020 Foo Ltd. Licensed under the MIT License.", "This file is licensed under the MIT License.", prose + "Released under the MIT License. " + prose, prose + "\n" + L._ISC.replace(", ", ",\n") + "\n" + "\n".join([prose] * 30)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r["license"], r["score"]) for r in L.scanned(d).orderBy("doc_id").collect()] == [("MIT", 1.0)] * 3 + [("ISC", 1.0)]
    assert L.Scanner().windows("all rights reserved " * 5000)[0].score == 1.0
