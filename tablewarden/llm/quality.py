"""A quality classifier of sparse rules, compiled into Spark columns.

Small trees are grown on text statistics of a labelled sample; every path in them is a rule, a conjunction of
comparisons.  A logistic model with a lasso penalty gives most rules the weight 0.  What is left becomes a sum of CASE
expressions, so that scoring whole texts needs the JVM only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import held_out

#: Bound of the training sample: slots of which each gives the labelled document with the smallest hash.
SLOTS = 8192
ACCEPT = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text.  A null text counts as empty; shares of an empty text are 0."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[ \\n\\t\\r]+"), lambda w: w != "")
    chars, n_words = F.length(text).cast("double"), F.size(words).cast("double")

    def share(kept: str) -> Column:
        return F.when(chars > 0, F.length(F.regexp_replace(text, f"[^{kept}]+", "")) / chars).otherwise(0.0)

    upper, letter, digit = share("\\p{Lu}"), share("\\p{L}"), share("0-9")
    plain = share("\\p{L}\\p{N}\\s.,")
    return {
        "chars": chars, "upper": upper, "letters": letter, "digits": digit, "symbols": F.lit(1.0) - plain,
        "word_chars": F.when(n_words > 0, chars / n_words).otherwise(0.0),
        "distinct": F.when(n_words > 0, F.size(F.array_distinct(words)) / n_words).otherwise(0.0),
        "words": n_words,
        "lines": F.when(chars > 0, (chars - F.length(F.translate(text, "\n", ""))) / chars).otherwise(0.0),
        "stops": F.when(chars > 0, (chars - F.length(F.translate(text, ".", ""))) / chars).otherwise(0.0),
    }


Rule = tuple[tuple[int, bool, float], ...]          # (statistic, above?, threshold), all of which hold


@dataclass
class RuleModel:
    names: list[str]
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def score(self, stats: dict[str, Column]) -> Column:
        """The chance of label 1 as a column."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            holds = F.lit(True)
            for i, above, at in rule:
                c = stats[self.names[i]]
                holds = holds & ((c > F.lit(at)) if above else (c <= F.lit(at)))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int, path: Rule, found: set[Rule], least: int = 20) -> None:
    if path:
        found.add(path)
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return
    best = (1e-9, -1, 0.0)
    base = y.mean() * (1 - y.mean())
    for c in columns:
        v = x[:, c]
        for at in np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25))):
            low = v <= at
            n = int(low.sum())
            if least <= n <= len(y) - least:
                a, b = y[low].mean(), y[~low].mean()
                gain = base - (n * a * (1 - a) + (len(y) - n) * b * (1 - b)) / len(y)
                if gain > best[0]:
                    best = (gain, int(c), float(at))
    _, c, at = best
    if c >= 0:
        low = x[:, c] <= at
        _grow(x[low], y[low], columns, depth - 1, (*path, (c, False, at)), found, least)
        _grow(x[~low], y[~low], columns, depth - 1, (*path, (c, True, at)), found, least)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.002,
        steps: int = 600) -> RuleModel:
    """Rules and weights from statistics ``x`` and labels ``y`` (0 or 1).

    Without rows the model gives every text the score 1: nothing speaks against it.  With one label only it gives the
    smoothed share of that label.
    """
    if not len(y):
        return RuleModel(names, intercept=40.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel(names, intercept=base)
    rng = np.random.default_rng(7)
    found: set[Rule] = set()
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        columns = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        _grow(x[rows], y[rows], columns, depth, (), found)
    rules = sorted(found)
    if not rules:
        return RuleModel(names, intercept=base)
    hit = np.stack([np.logical_and.reduce([(x[:, i] > at) if above else (x[:, i] <= at) for i, above, at in r]) for r in rules], 1).astype(float)
    mean = hit.mean(0)
    scale = np.maximum(hit.std(0), 0.02)
    z = (hit - mean) / scale
    step = 4.0 / max(1.0, float(np.linalg.eigvalsh(z.T @ z / len(y))[-1]))
    w, b, v, momentum = np.zeros(len(rules)), base, np.zeros(len(rules)), 1.0
    for _ in range(steps):                                   # accelerated proximal gradient
        p = 1 / (1 + np.exp(-np.clip(z @ v + b, -30, 30)))
        moved = v - step * (z.T @ (p - y) / len(y))
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        b -= step * float((p - y).mean())
        after = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    keep = np.flatnonzero(np.abs(w) > 1e-3)
    return RuleModel(names, [rules[i] for i in keep], (w[keep] / scale[keep]).tolist(),
                     float(b - (w[keep] / scale[keep] * mean[keep]).sum()))


def train(docs: DataFrame, labels: DataFrame, slots: int = SLOTS) -> RuleModel:
    """A model from the labelled rows that are not held out, at most about ``slots`` of them.

    A document with several labels counts with the smallest; null labels are left out.  The driver gets one row of
    statistics for each document of the sample.
    """
    known = (labels.where(~held_out() & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("quality"))
             .withColumn("mark", F.xxhash64("doc_id")))
    chosen = known.groupBy(F.pmod("mark", F.lit(slots)).alias("slot")).agg(F.min_by(F.struct("doc_id", "quality"), "mark").alias("row"))
    few = F.broadcast(chosen.select("row.doc_id", "row.quality"))
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(few, "doc_id").select("doc_id", "quality", *(c.alias(n) for n, c in stats.items()))
    got = sorted(tuple(r) for r in rows.distinct().collect())
    data = np.array([r[1:] for r in got], float).reshape(len(got), 1 + len(stats))
    return fit(data[:, 1:], data[:, 0], list(stats))


def classify(docs: DataFrame, model: RuleModel, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 where score >= ``accept``); columns of these names are replaced.

    A null text is scored as an empty one.  Repeated rows score alike.
    """
    docs = docs.drop("score", "predicted")
    names = {n: f"__stat_{n}" for n in model.names}
    wide = docs.select("*", *(c.alias(names[n]) for n, c in statistics(docs["text"]).items()))
    # a row out of an array of one: a filter on the score cannot be pushed below it, where each rule would be written
    # out with the whole expression of its statistics
    held = wide.select(*(f"`{c}`" for c in docs.columns), F.explode(F.array(F.struct(*names.values()))).alias("__stats"))
    score = model.score({n: F.col("__stats")[c] for n, c in names.items()})
    return held.withColumn("score", score).drop("__stats").withColumn("predicted", (F.col("score") >= accept).cast("int"))
