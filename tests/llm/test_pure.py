"""Driver-side pieces without Spark."""

import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodegraph.llm import html_text as H
from lodegraph.llm import near_dedup as N
from lodegraph.llm import neighbours as A
from lodegraph.llm import packing as P
from lodegraph.llm import quality_classifier as Q
from lodegraph.llm import warc as W


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    size = 256
    counts = np.bincount([min(size, 1 + int(rng.expovariate(1 / 60))) for _ in range(rng.choice([1, 40, 3000]))], minlength=size + 1)
    plan, total = P.packing_plan(counts, size), Counter()
    for uses, n in plan:
        assert sum(v * c for v, c in uses.items()) <= size
        for v, c in uses.items():
            total[v] += c * n
    assert all(total[v] == counts[v] for v in range(1, size + 1))
    lower = math.ceil(sum(v * counts[v] for v in range(size + 1)) / size)
    assert sum(n for _, n in plan) <= max(lower + 1, 1.02 * lower)


def test_patterns_are_exact_and_fit_is_non_negative():
    found = P.patterns(np.array([10, 20, 30, 64, 54, 44]), 64)
    assert all(sum(p) == 64 and len(p) <= 3 for p in found) and (64,) in found and (54, 10) in found
    counts = np.bincount([64] * 5 + [54] * 3 + [10] * 3, minlength=65)
    x = P.fitted(counts, found)
    assert min(x) >= 0 and x[found.index((64,))] == pytest.approx(5) and x[found.index((54, 10))] == pytest.approx(3)


def test_encoder_equals_the_tokenizer():
    e = P.encoder(P.vocabulary())
    texts = ["It's DON'T we'll İSTANBUL ½ ²³ ªº", "nbsp\xa0z é Σίσυφος ΑΣ 日本語 <|endoftext|>", "'S 're!!'s ''d a\r\n\tb\x0b\x0cc", "ŉ ſtreet “q” … don’t \x1c x\x85y", "", None, "### token=4 a.b,c!!d" * 50]
    assert e.ids(texts) == [e.whole(t) if t else b"" for t in texts]


def test_encoder_remembers_a_bounded_number_of_words():
    e, most = P.Encoder(P.vocabulary()), 0
    for k in range(12):  # words that never come again
        texts = [" ".join(f"{chr(97 + k)}{chr(97 + j)}{n:x}" for n in range(5000)) for j in range(10)]
        got = e.ids(texts)
        most = max(most, len(e))
    assert most < 500_000 and got == [e.whole(t) for t in texts]


def test_encoder_keeps_the_words_in_use_when_it_forgets(monkeypatch):
    class Counted:
        def __init__(self, merger):
            self.merger, self.seen = merger, Counter()

        def encode_batch_fast(self, texts, **how):
            self.seen.update(w for t in texts for w in t.split())
            return self.merger.encode_batch_fast(texts, **how)

    monkeypatch.setattr(P, "REMEMBERED", 1000)
    e, name = P.Encoder(P.vocabulary()), lambda n: "".join(chr(97 + int(c)) for c in str(n))
    e.merger = Counted(e.merger)
    common = [f"common{name(n)}" for n in range(300)]
    for k in range(10):  # in each round 300 words that come again and 300 that don't
        texts = [" ".join(common), None, "", " \n", " ".join(f"rare{name(300 * k + n)}." for n in range(300)) + "\n", "日本 é"]
        assert e.ids(texts) == [e.whole(t) if t else b"" for t in texts] and len(e) <= 1600
    assert all(e.merger.seen[w] == 1 for w in common)
    assert e.ids([]) == [] and e.ids([None]) == [b""]


def test_shingles_and_minhash():
    assert len(N.shingles(None, 4)) == len(N.shingles(" \n\t", 4)) == 0
    assert len(N.shingles("one two", 4)) == 1
    assert np.array_equal(N.shingles("A b\x0bC d e", 4), N.shingles("a B c\nD E", 4))
    assert not np.array_equal(N.shingles("É b c d", 4), N.shingles("é b c d", 4))
    a = N.shingles(" ".join(f"w{i}" for i in range(400)), 4)
    b = N.shingles(" ".join(f"w{i}" for i in range(40, 440)), 4)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((N.minhashes(a) == N.minhashes(b)).mean() - true) < 0.25


def test_search_is_exact_with_an_open_test():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((700, 8))
    x[5] = x[6]
    norm2 = (x * x).sum(1).max() * (1 + 1e-12)
    q, ids = x[:20], np.arange(700)
    got, _ = A.search(x, A._projected(x, norm2), ids, q, A._projected_query(q), norm2, 10, np.full(20, -np.inf), 1e9)
    for i, (rows, score) in enumerate(got):
        s = (x * q[i]).sum(1)
        assert list(rows) == list(np.lexsort((ids, -s))[:10]) and np.array_equal(score, s[rows])


def test_tree_and_quantile():
    assert A.chi_square_point(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    x = np.random.default_rng(1).standard_normal((1000, 4))
    cells = A.cells_of(x, A.split_tree(x, 3))
    assert Counter(cells.tolist()).keys() == set(range(8)) and max(Counter(cells.tolist()).values()) < 200
    assert sorted(np.concatenate(A.leaves(np.zeros((300, 2)))).tolist()) == list(range(300))


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 4))
    y = 1.0 - ((x[:, 0] > 0.7) & (x[:, 2] <= 0.4))
    m = Q.fit(x, y, list("abcd"))
    assert ((m.score(x) >= 0.5) == (y == 1)).mean() > 0.97
    assert len(m.rules) < 200
    assert Q.fit(x[:0], y[:0], list("abcd")).score(x[:3]).tolist() == [0.5] * 3
    assert Q.fit(x, np.ones(3000), list("abcd")).score(x[:1])[0] > 0.99


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/x">Menu</a></ul></nav><header><h1>Site</h1></header><div class="ad">Buy</div>
<article class="post-12"><h1>Head&amp;line</h1><p>One <b>bold</b> &eacute;t&#233; text of the page, long enough.<br>Next
line<p>Two &lt;tags&gt; and more words that make the paragraph win.<form><input></form><div class="comments">No!</div>
<aside>Side</aside><p hidden>Hid</p></article><footer>&copy; F</footer>"""


def test_main_text():
    want = "Head&line One bold été text of the page, long enough. Next line Two <tags> and more words that make the paragraph win."
    assert H.main_text(PAGE) == want
    assert H.main_text(PAGE, "/html.x/none") == want
    best = H.votes(PAGE)[0][0]
    assert best.endswith("/article.post-") and H.main_text(PAGE, best) == want
    assert H.main_text(None) == H.main_text("") == "" and H.main_text("plain  words") == "plain words"
    assert H.main_text("<p>a<p>b<table><tr><td>c<td>d") == "a b c d"
    assert H.main_text("<div>cut <b") == "cut <b"


def test_warc_round_trip():
    payload = "ü\r\n\r\n".encode() * 50
    d = __import__("hashlib").sha256(payload).hexdigest()
    data = W.member(W.record(1, "http://a/\r\nX: y", payload, d, None)) + W.member(W.record(2, "", payload, d, 1)) + W.member(W.record(None, "u", b"", d, None))
    got = list(W.records(io.BytesIO(data)))
    assert [h["WARC-Type"] for h, _ in got] == ["response", "revisit", "response"]
    assert got[0][1].endswith(payload) and got[1][0]["X-Refers-To-Key"] == "1" and not got[1][1].endswith(payload)
    assert W.member(b"x") == W.member(b"x") and zlib.decompress(W.member(b"x"), 31) == b"x"
    with pytest.raises(EOFError):
        list(W.records(io.BytesIO(data[:-30])))


def test_main_text_keeps_the_whole_article():
    lead, long = "<h1>T</h1><div class='lead'><p>A lead.</p></div>", "Much longer text of the post. " * 5
    tail = f"<div class='post-content'><p>{long}</p></div><div class='related'><p>Others</p></div>"
    want = f"T A lead. {long.strip()}"
    for page in (f"<article>{lead}{tail}</article>", f"<main>{lead}<article>{tail}</article></main>"):
        page = f"<html><body><nav>Menu</nav>{page}<footer>End</footer></body></html>"
        assert H.main_text(page) == H.main_text(page, H.votes(page)[0][0]) == want
