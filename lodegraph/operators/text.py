"""Text and link operators: tokens, TF-IDF, cosine search, grep with enclosing spans, URL normalisation and matching."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pairs import listed, paired

STOP = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "as", "at", "by", "be", "are", "was", "that", "this", "from", "de", "la", "le", "der", "die", "und", "el", "en")
SUFFIXES = ("ing", "tion", "ment", "ed", "er", "es", "ly", "s")


def stem(t: Column) -> Column:
    """The first suffix of SUFFIXES that leaves three letters is cut."""
    out = F.when(F.lit(False), t)
    for s in SUFFIXES:
        out = out.when(t.endswith(s) & (F.length(t) - len(s) >= 3), F.expr(f"left(t, length(t) - {len(s)})"))
    return out.otherwise(t)


def split_identifiers(text: Column) -> Column:
    """Camel and acronym borders become spaces."""
    return F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")


def tokens(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, t): stemmed lower-case tokens of two letters or more that aren't stop words, one row each."""
    parts = F.split(F.lower(split_identifiers(F.coalesce(F.col(text), F.lit("")))), "[^a-zA-Z0-9]+")
    d = docs.select(F.col(doc).alias("doc"), F.explode(parts).alias("t")).filter((F.length("t") >= 2) & ~F.col("t").isin(*STOP))
    return d.select("doc", stem(F.col("t")).alias("t"))


def term_counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc", "t").agg(F.count(F.lit(1)).alias("n"))


#: Stems that a worker remembers, and rows that it hands over at once.
_STEMS, _ROWS = 200_000, 200_000
_BORDER, _WORD = re.compile("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), re.compile("[a-zA-Z0-9]{2,}")
#: All letters that aren't ASCII and become so in lower case.
_INTO_ASCII = ("\u0130", "\u212a")


def _terms(word: str) -> list[str]:
    """The stems of one run of ASCII letters and digits."""
    parts = [t for t in _BORDER.sub(" ", word).lower().split(" ") if len(t) >= 2 and t not in STOP]
    return [next((t[: -len(s)] for s in SUFFIXES if t.endswith(s) and len(t) - len(s) >= 3), t) for t in parts]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc, t, n, most) of each row of (doc, text): what tokens() and term_counts() say of it. A row's words are counted before they
    are split and stemmed, so each different word is looked at once."""
    known: dict[str, list[str]] = {}
    for b in batches:
        docs, size, terms, ns, most = [], [], [], [], []
        for doc, text in zip(b["doc"], b["text"], strict=True):
            by: dict[str, int] = {}
            if text and any(x in text for x in _INTO_ASCII):
                text = _BORDER.sub(" ", text).lower()
            for w, n in Counter(_WORD.findall(text or "")).items():
                if w not in known:
                    if len(known) >= _STEMS:
                        known.clear()
                    known[w] = _terms(w)
                for t in known[w]:
                    by[t] = by.get(t, 0) + n
            if by:
                docs.append(doc)
                size.append(len(by))
                terms += by
                ns += by.values()
                most += [max(by.values())] * len(by)
            if len(terms) > _ROWS:
                yield pd.DataFrame({"doc": pd.Series(docs, dtype=b["doc"].dtype).repeat(size).to_numpy(), "t": terms, "n": ns, "most": most})
                docs, size, terms, ns, most = [], [], [], [], []
        if terms:
            yield pd.DataFrame({"doc": pd.Series(docs, dtype=b["doc"].dtype).repeat(size).to_numpy(), "t": terms, "n": ns, "most": most})


def counted(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, t, n, most): term_counts() and the doc's greatest count. Where no id comes twice or is missing, which is looked up, each
    row is counted where it is read and nothing is shuffled."""
    ids = docs.groupBy(doc).agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") > 1) | F.col(doc).isNull())
    if ids.isEmpty():
        d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
        return d.mapInPandas(_count, f"doc {d.schema['doc'].dataType.simpleString()}, t string, n long, most long")
    return term_counts(tokens(docs, doc, text)).withColumn("most", F.max("n").over(Window.partitionBy("doc")))


def tfidf(counts: DataFrame, total: DataFrame) -> DataFrame:
    """(doc, t, weight): n / most frequent term of the doc (most), times ln((N + 1) / (df + 1)) + 1. total: one row (docs)."""
    df = counts.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total.toDF("docs")))
    idf = df.select("t", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    return counts.select("doc", "t", (F.col("n") / F.col("most")).alias("tf")).join(idf, "t").select("doc", "t", (F.col("tf") * F.col("idf")).alias("weight"))


def cosine_topk(weights: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(doc, score) of the k documents nearest to the query's (t, q) by cosine; only those that share a term. The query
    is a handful of terms by nature; weights are read once."""
    qn = query.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    q = F.broadcast(query.groupBy("t").agg(F.sum("q").alias("q")))
    d = weights.join(q, "t", "left").groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum(F.col("weight") * F.col("q")).alias("dot")).filter("dot > 0")
    return d.crossJoin(F.broadcast(qn)).select("doc", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score")).orderBy(F.desc("score"), "doc").limit(k)


def lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, line from 1, body)."""
    return docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\n")).alias("p", "body")).select("doc", (F.col("p") + 1).alias("line"), "body")


def grep(docs: DataFrame, doc: str, text: str, pattern: str, block: int = 5) -> DataFrame:
    """(doc, line, span): matching lines and the block of lines that holds each. Texts that can't match are dropped before
    they are split."""
    d = lines(docs.filter(F.col(text).rlike(pattern)), doc, text).filter(F.col("body").rlike(pattern))
    return d.select("doc", "line", F.floor((F.col("line") - 1) / block).cast("int").alias("span"))


def url_template(url: Column) -> Column:
    """Scheme, host, query and fragment go; numbers become {}, extensions and a last slash go; lower case."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z]+://[^/?#]*", ""), "[?#].*$", "")
    path = F.regexp_replace(F.regexp_replace(path, "\\.html?$", ""), "/$", "")
    return F.regexp_replace(path, "/[0-9]+", "/{}")


def url_match(routes: DataFrame, calls: DataFrame) -> DataFrame:
    """(route_id, call_id) of equal templates. Frequent templates make many pairs, so ids are joined as lists and the pairs of
    lists are dealt out."""
    r, c = listed(routes, ["template"], "route_id", "route_id"), listed(calls, ["template"], "call_id", "call_id")
    return paired(r.join(c, "template"), "route_id", "call_id")


def orphan_routes(routes: DataFrame, hits: DataFrame) -> DataFrame:
    """Routes (route_id, segment) of which no segment occurs in hits (segment)."""
    used = routes.join(hits, "segment", "left_semi").select("route_id").distinct()
    return routes.select("route_id").distinct().join(used, "route_id", "left_anti")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)
