"""Scalar and aggregate expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ERFC_TERMS = (1.26551223, -1.00002368, -0.37409196, -0.09678418, 0.18628806, -0.27886807, 1.13520398, -1.48851587, 0.82215223, -0.17087277)


def r6(c: Column) -> Column:
    """Rounded for display and comparison."""
    return F.round(c, 6)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def or_one(c: Column) -> Column:
    """1 for null and for 0."""
    return F.when(c.isNull() | (c == 0), F.lit(1)).otherwise(c)


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def smoothstep(c: Column) -> Column:
    x = clamp(c)
    return x * x * (F.lit(3.0) - 2 * x)


def erfc(c: Column) -> Column:
    """Complementary error function for arguments of 0 or more: rational Chebyshev form, relative error below 1.2e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + c / 2)
    poly = F.lit(ERFC_TERMS[-1])
    for a in reversed(ERFC_TERMS[1:-1]):
        poly = F.lit(a) + t * poly
    return t * F.exp(-c * c - F.lit(ERFC_TERMS[0]) - t * poly)


def entropy(share: Column, n: Column) -> Column:
    """Shannon entropy of a group's shares, divided by log2 of their number; 0 for one share. An aggregate."""
    return F.when(n > 1, -F.sum(F.when(share > 0, share * F.log2(share)).otherwise(0.0)) / F.log2(n)).otherwise(F.lit(0.0))


def case_style(name: Column) -> Column:
    """UPPER, snake, kebab, camel, pascal or other."""
    return (
        F.when(name.rlike("^[A-Z][A-Z0-9_]*$") & (F.length(name) > 1), "UPPER")
        .when(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), "snake")
        .when(name.rlike("^[a-z][a-z0-9]*(-[a-z0-9]+)+$"), "kebab")
        .when(name.rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$"), "camel")
        .when(name.rlike("^[A-Z][a-zA-Z0-9]*[a-z][a-zA-Z0-9]*$"), "pascal")
        .when(name.rlike("^[a-z][a-z0-9]*$"), "lower")
        .otherwise("other")
    )


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a path glob. In a pattern with ** that alone crosses folders; in one without, * and ? do."""
    import re

    out, k = "", 0
    star, one = ("[^/]*", "[^/]") if "**" in pattern else (".*", ".")
    while k < len(pattern):
        c = pattern[k]
        if pattern[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif pattern[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": star, "?": one}.get(c, re.escape(c)), k + 1
    return f"^{out}$"
