"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees over the statistics are taken apart into paths; each path
is a conjunctive rule.  A lasso-penalised logistic regression weighs the rules
and keeps few.  The rules and their weights compile into one Spark column
expression, so scoring is a projection.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled


def _count(text: Column, pattern: str) -> Column:
    """Characters that match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; null is the empty text, of which all are 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, r"\n"), lambda x: x != "")
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    return {
        "log_chars": F.log1p(F.length(t)),
        "log_words": F.log1p(F.size(words)),
        "word_length": F.length(t) / n,
        "upper": _count(t, r"[A-Z]+") / chars,
        "digits": _count(t, r"[0-9]+") / chars,
        "marks": _count(t, r"[.,;:?'\"]+") / n,
        "signs": _count(t, r"[!#$%&*|<>{}=+~^@\\/_]+") / n,
        "line_length": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "new_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "new_words": F.size(F.array_distinct(words)) / F.sqrt(n.cast("double")),
    }


class RuleModel:
    """Rules over statistics and their weights.

    A rule is a tuple of ``(name, above, bound)``: the statistic is greater
    than the bound, or not.
    """

    def __init__(self, rules: list[tuple[tuple[str, bool, float], ...]], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self, text: Column) -> Column:
        """The score of a text as a column expression."""
        stats = F.struct(*[c.cast("double").alias(k) for k, c in statistics(text).items()])
        return F.transform(F.array(stats), lambda s: self._score(s))[0]

    def _score(self, s: Column) -> Column:
        z = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for name, above, bound in rule:
                holds = holds & ((s[name] > bound) if above else (s[name] <= bound))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, step: np.ndarray, rate: float) -> None:
    """Split the rows by the largest gain, as deep as asked; note each path below the root."""
    if path:
        out.append(path)
    best = (1e-6, None, None)
    if depth and len(rows) > 40:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j, c in enumerate(cuts):
            bins = np.searchsorted(c, x[rows, j], side="left")
            left_g, left_h = (np.bincount(bins, w[rows], len(c) + 1).cumsum()[:-1] for w in (g, h))
            small = np.minimum(left_h, total_h - left_h) < 1.0
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            gain[small] = 0
            if len(c) and gain.max() > best[0]:
                best = (gain.max(), j, c[gain.argmax()])
    if best[1] is None:
        step[rows] -= rate * g[rows].sum() / (h[rows].sum() + 1)
        return
    above = x[rows, best[1]] > best[2]
    for side, part in ((False, rows[~above]), (True, rows[above])):
        _grow(x, cuts, g, h, part, depth - 1, (*path, (best[1], side, float(best[2]))), out, step, rate)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty by accelerated proximal gradients."""
    a = np.column_stack([r, np.ones(len(r))])
    size = 4 / max(np.linalg.norm(a, 2) ** 2 / len(a), 1e-9)
    w = v = np.zeros(a.shape[1])
    for t in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -50, 50))) - y) / len(a)
        new = v - size * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * penalty, 0)
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def train(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 20, depth: int = 3, penalty: float = 2e-4) -> RuleModel:
    """A rule model from rows of statistics and 0/1 labels."""
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = math.log(rate / (1 - rate))
    if len(y) < 2 or y.min() == y.max():
        return RuleModel([], [], bias)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))) for c in x.T]
    f, paths = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        _grow(x, cuts, p - y, p * (1 - p), np.arange(len(y)), depth, (), paths, step, 0.3)
        f = f + step
    rules = list(dict.fromkeys(paths))
    holds = np.ones((len(y), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, bound in rule:
            holds[:, k] *= (x[:, j] > bound) == above
    weights, bias = _lasso(holds, y.astype(float), penalty)
    kept = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel([tuple((names[j], bool(above), bound) for j, above, bound in rules[k]) for k in kept], [float(weights[k]) for k in kept], bias)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> RuleModel:
    """A model from documents and the labels of some of them.

    At most about ``max_rows`` labelled documents, chosen by a hash of the id,
    teach it; only their statistics reach the driver.  Null labels are left
    out, of several labels of an id the largest counts.  Without labels, or
    with one kind only, every score is the share of label 1 (0.5 without any).
    """
    labels = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = sampled(labels, "quality", max_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # bounded by max_rows
    stats = statistics(F.col("text"))
    rows = sorted(map(tuple, sample.select("y", *[c.cast("double").alias(k) for k, c in stats.items()]).collect()))
    data = np.array(rows, float).reshape(len(rows), len(stats) + 1)
    return train(data[:, 1:], data[:, 0], list(stats), **options)


def score_quality(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``score`` (0 to 1).  A null text scores as
    the empty one, very long texts are read whole, repeated rows and ties score
    alike; other columns are ignored, no rows give no rows."""
    return docs.select(F.col(id_col), model.column(F.col(text_col).cast("string")).alias("score"))


def keep_good(docs: DataFrame, model: RuleModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that score at least ``threshold``; repeated rows all stay or all go, no rows give no rows."""
    return docs.filter(model.column(F.col(text_col).cast("string")) >= threshold)
