"""Quality classifier: a sparse rule ensemble.

1. Boosted shallow trees are grown (numpy, on the driver) over text statistics of a bounded sample of labelled rows.
2. Every root-to-node path is a conjunctive rule; lasso logistic regression gives most of them weight 0.
3. The rules that remain are compiled into one Spark column expression, so scoring is a projection over whole texts.

The sample is the SAMPLE labelled rows of smallest hash (a parameter), the same at every run. Only statistics of the text are
inputs. Without labelled rows the score is 0.5; with one class only, the smoothed share of that class. Null and empty texts
have all statistics 0 and a score like any other; texts of any length are read whole. Repeated rows are scored each; null labels teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, kept_where, staged, table
from .textstats import with_stats

SAMPLE = 20_000
THRESHOLD = 0.3


def features(p: str = "") -> dict[str, Column]:
    """Shares and means from the columns of with_stats(), rounded so that learning and scoring see equal numbers."""
    c = lambda x: F.col(f"{p}{x}").cast("double")
    part = lambda a, b: F.coalesce(F.round(c(a) / F.greatest(c(b), F.lit(1.0)), 6), F.lit(0.0))
    return {
        "log_words": F.round(F.log1p(c("n_words")), 6),
        "mean_word": part("word_chars", "n_words"),
        "symbols": part("n_symbols", "word_chars"),
        "capitals": part("n_upper", "word_chars"),
        "digits": part("n_digits", "word_chars"),
        "marks": part("n_marks", "n_words"),
        "stops": part("n_stops", "n_words"),
        "distinct": part("n_distinct", "n_words"),
        "repeats": part("n_repeat_words", "n_words"),
        "same_lines": part("n_dup_lines", "n_lines"),
        "line_words": part("n_words", "n_lines"),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


@dataclass
class Model:
    names: list[str]
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, cols: dict[str, Column]) -> Column:
        """The score, 0 to 1, as a column expression."""
        total = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            cond = None
            for f, above, t in rule:
                one = cols[self.names[f]] > F.lit(t) if above else cols[self.names[f]] <= F.lit(t)
                cond = one if cond is None else cond & one
            total = total + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + rule_matrix(x, self.rules) @ np.array(self.weights, dtype=float))))


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for f, above, t in rule:
            out[:, k] *= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def _paths(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, residual: np.ndarray, rows: np.ndarray, allowed: np.ndarray, depth: int, least: int, path: Rule, out: list[Rule], fit: np.ndarray) -> None:
    """Grows a regression tree on `residual` by histograms; collects each node's path and writes the leaves' means into fit."""
    if path:
        out.append(path)
    r = residual[rows]
    fit[rows] = r.mean()
    if depth == 0 or len(rows) < 2 * least or np.ptp(r) < 1e-9:
        return
    best, total = (1e-7, -1, 0.0), r.sum()
    for f in allowed:
        if not len(bins[f]):
            continue
        n = np.bincount(codes[rows, f], minlength=len(bins[f]) + 1).cumsum()[:-1]
        s = np.bincount(codes[rows, f], weights=r, minlength=len(bins[f]) + 1).cumsum()[:-1]
        ok = (n >= least) & (len(rows) - n >= least)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float(bins[f][k]))
    if best[1] >= 0:
        _, f, t = best
        left = x[rows, f] <= t
        _paths(x, bins, codes, residual, rows[left], allowed, depth - 1, least, (*path, (f, False, t)), out, fit)
        _paths(x, bins, codes, residual, rows[~left], allowed, depth - 1, least, (*path, (f, True, t)), out, fit)


def extract_rules(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, seed: int = 5) -> list[Rule]:
    """The distinct paths of `trees` boosted trees, each on half of the rows and features."""
    rng = np.random.default_rng(seed)
    bins = [np.round(np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))), 6) for c in x.T]
    bins = [b[b < c.max()] for b, c in zip(bins, x.T, strict=True)]
    codes = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bins, x.T, strict=True)], 1)
    margin, rules = np.zeros(len(y)), []
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        allowed = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        tree: list[Rule] = []
        _paths(x, bins, codes, residual, rows, allowed, depth, max(5, len(y) // 500), (), tree, np.zeros(len(y)))
        for rule in tree:
            held = rule_matrix(x, [rule])[:, 0] > 0
            if len(rule) == depth and held.any():
                margin[held] += 1.5 * residual[held].mean()
        rules += tree
    seen: dict[bytes, Rule] = {}
    for rule in sorted(set(rules), key=lambda r: (len(r), r)):  # of rules that hold for the same rows, the shortest
        held = rule_matrix(x, [rule])[:, 0] > 0
        if 0 < held.sum() < len(y):
            seen.setdefault(np.packbits(held).tobytes(), rule)
    return list(seen.values())


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 0.001, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias (not penalised) and weights, by accelerated proximal gradient on standardised columns."""
    mean, sd = z.mean(0), z.std(0) + 1e-9
    s = (z - mean) / sd
    n, k = s.shape
    rate = 4 / (np.linalg.eigvalsh(s.T @ s / n)[-1] + 1) if k else 1.0
    w = v = np.zeros(k)
    b = vb = 0.0
    t = 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(vb + s @ v))) - y
        nw = v - rate * (s.T @ g / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nb = vb - rate * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return float(b - (w * mean / sd).sum()), w / sd


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    if len(y) == 0:
        return Model(names, 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max() or len(y) < 20:
        return Model(names, float(np.log(share / (1 - share))))
    rules = extract_rules(x, y)
    bias, w = lasso_logistic(rule_matrix(x, rules), y)
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return Model(names, round(bias, 9), [rules[k] for k in kept], [round(float(w[k]), 9) for k in kept])


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fits a model to the `sample` labelled rows of smallest hash among those whose crc32(doc_id as text) mod 5 isn't 0."""
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    few = labels.filter(~held_out & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    few = staged(few.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample), "labelled")
    names = list(features())
    text = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `sample` rows of two numbers at most
    text = with_stats(text, "text").select("doc_id", "quality", *[c.alias(k) for k, c in features().items()])
    rows = text.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *names).limit(2 * sample).collect()
    x = np.array([[r[n] for n in names] for r in rows], dtype=float).reshape(-1, len(names))
    return fit(x, np.array([r["quality"] for r in rows], dtype=float), names)


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` with the column `name`. A projection over the whole texts."""
    p = free_name(docs, "_c_", prefix=True)
    d = with_stats(docs, "text", p)
    cols = features(p)
    d = d.select(*docs.columns, *[c.alias(f"{p}{k}") for k, c in cols.items()])
    return d.select(*docs.columns, model.column({k: F.col(f"{p}{k}") for k in cols}).alias(name))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score `threshold` or more, with the same columns."""
    score, good = free_name(docs, "score"), free_name(docs, "good")
    d = scored(docs, learn(docs, labels), score).withColumn(good, F.col(score) >= threshold)
    return kept_where(d, good).select(*docs.columns)


def op10_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents; learns only from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    d = scored(docs, model)
    return d.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))


__all__ = ["Model", "accepted", "extract_rules", "features", "fit", "lasso_logistic", "learn", "op10_rule_ensemble_quality", "rule_matrix", "scored"]
