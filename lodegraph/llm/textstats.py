"""Statistics of whole texts as Spark column expressions: one pass over the text, no shuffle, no Python.

Null and empty texts have 0 in every count. Words are `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Up to so many words, a window's hash and place share one 64-bit number (46 bits or more of hash); above, they are sorted as
#: pairs. Either way windows whose hashes meet are compared by their words.
PACKED = 1 << 17
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_digits", "n_marks", "n_stops", "n_distinct"]


def _longs() -> Column:
    return F.array().cast("array<bigint>")


def _covered(places: Column) -> Column:
    """Words that 3-word windows at the given places (sorted) cover."""
    n = F.size(places)
    gaps = F.zip_with(F.slice(places, 1, F.greatest(n - 1, F.lit(0))), F.slice(places, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3).cast("long")))
    return F.when(n > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda s, g: s + g)).otherwise(F.lit(0).cast("long"))


def with_stats(df: DataFrame, text: str, p: str = "", *, more: bool = True) -> DataFrame:
    """Adds long columns named `p` plus BASE, and plus MORE if asked for. n_repeat_words: the words that lie in a 3-word
    window which the text holds twice or more, its first place included."""
    t, w, h, lines = (f"{p}__{x}" for x in ("t", "w", "h", "lines"))
    keep = df.columns
    d = df.withColumn(t, F.coalesce(F.col(text), F.lit(""))).withColumn(w, words(F.col(t)))
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col(w), i), F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)))
    d = d.withColumn(h, F.when(n >= 3, hashes).otherwise(_longs()))
    d = d.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    count = lambda chars: F.regexp_count(F.col(t), F.lit(chars)).cast("long")
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }
    if more:
        out |= {
            "n_lines": F.size(lines).cast("long"),
            "n_upper": count("\\p{Lu}"),
            "n_digits": count("\\p{Nd}"),
            "n_marks": count("[!?=+_~^@\\\\/{}\\[\\]]"),
            "n_stops": count("[.,;:]"),
            "n_distinct": F.size(F.array_distinct(F.col(w))).cast("long"),
        }
    m = F.size(h)
    bits = f"{p}__bits"
    d = d.withColumn(bits, F.greatest(F.lit(1), F.ceil(F.log2(m + 1))).cast("int"))
    packed = f"{p}__packed"
    some = F.size(F.array_distinct(F.col(h))) < m
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, F.col(bits)) - one
    top = lambda v: F.call_function("shiftright", v, F.col(bits))
    d = d.withColumn(packed, F.when(some & (m <= PACKED), F.array_sort(F.transform(h, lambda v, i: F.call_function("shiftleft", top(v), F.col(bits)).bitwiseOR(i.cast("long"))))).otherwise(_longs()))
    same = lambda a, b: F.coalesce(top(a) == top(b), F.lit(False))
    twice = F.filter(F.col(packed), lambda v, i: same(v, F.get(F.col(packed), i + 1)) | ((i > 0) & same(v, F.get(F.col(packed), i - 1))))
    places = f"{p}__places"
    near = F.transform(twice, lambda v: v.bitwiseAND(mask))
    pairs = f"{p}__pairs"
    d = d.withColumn(places, near).withColumn(pairs, F.when(some & (m > PACKED), F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.cast("long").alias("i"))))))
    equal = lambda a, b: F.coalesce(a["v"] == b["v"], F.lit(False))
    twice = F.filter(F.col(pairs), lambda v, i: equal(v, F.get(F.col(pairs), i + 1)) | ((i > 0) & equal(v, F.get(F.col(pairs), i - 1))))
    # windows whose hashes meet are told apart by their words
    alike, found = f"{p}__alike", f"{p}__found"
    at = lambda i, k: F.get(F.col(w), (i + k).cast("int"))
    d = d.withColumn(alike, F.coalesce(F.transform(twice, lambda v: v["i"]), F.col(places)))
    d = d.withColumn(found, F.array_sort(F.transform(F.col(alike), lambda i: F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), at(i, 2).alias("c"), i.alias("i")))))
    words_same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    kept = F.filter(F.col(found), lambda x, i: words_same(x, F.get(F.col(found), i + 1)) | ((i > 0) & words_same(x, F.get(F.col(found), i - 1))))
    sure = f"{p}__sure"
    d = d.withColumn(sure, F.array_sort(F.transform(kept, lambda x: x["i"])))
    out["n_repeat_words"] = _covered(F.col(sure))
    return d.select(*keep, *[out[k].alias(f"{p}{k}") for k in [*BASE, *(MORE if more else [])]])
