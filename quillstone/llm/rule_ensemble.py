"""Quality classification by a sparse ensemble of rules.

Statistics of a document are Spark column expressions. Small regression trees are grown on labelled
documents, each on the gradient of those before it and on a part of the rows; every path from a root
to a node is a conjunction of comparisons, a rule. A logistic regression with lasso weights over all
rules leaves few of them with a weight other than zero, and those are compiled into one Spark
expression, so scoring is a projection inside the JVM without any Python.

Defined results
    null text counts as the empty text, whose ratios are 0. A label that is null, or whose document is
    missing, isn't fitted on; a doc_id labelled twice with the same quality counts once, with both
    qualities not at all; a labelled doc_id of several texts is fitted on the one of the smallest
    statistics. No label of one of the qualities (an empty table included): every document
    gets the probability of the other, or 1 without labels. Repeated rows: each is scored by itself.
    Ties (a probability equal to the bound) are kept. Columns of the input are dropped but doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ready

#: Labelled documents fitted on, at most.
FIT_ROWS = 4000
TREES, DEPTH, RATE, PART = 40, 3, 0.3, 0.5
CUTS = 24
BOUND = 0.5


def statistics(text: Column) -> dict[str, Column]:
    """Of whole texts, each by one pass."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    size = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(size, F.lit(1))
    # A letter of one byte is counted by what its removal takes away, without a pattern.
    letters = lambda own: sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in own), F.lit(0)) / F.greatest(size, F.lit(1))
    words = F.regexp_count(text, F.lit(r"\S+"))
    return {
        "chars": size.cast("double"),
        "words": words.cast("double"),
        "word_length": size / F.greatest(words, F.lit(1)),
        "upper": share(r"\p{Lu}"),
        "digits": share(r"\p{N}"),
        "shouts": letters("!?"),
        "stops": letters(".,;:"),
        "symbols": share(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"),
        "lines": letters("\n"),
        "short_words": F.regexp_count(text, F.lit(r"(?<!\S)\p{L}{1,3}(?!\S)")) / F.greatest(words, F.lit(1)),
        "repeats": F.regexp_count(text, F.lit(r"(?<!\S)(\S+) \1(?!\S)")) / F.greatest(words, F.lit(1)),
    }


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater than?, cut) and ...


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, greater, cut in rule:
        out &= (x[:, k] > cut) == greater
    return out


def _split(x: np.ndarray, g: np.ndarray, cuts: list[np.ndarray]) -> tuple[float, int, float] | None:
    """The cut that lowers the squared error most."""
    best = None
    total, n = g.sum(), len(g)
    for k, own in enumerate(cuts):
        above = x[:, k][:, None] > own[None, :]
        c = above.sum(axis=0)
        s = g @ above
        ok = (c >= 5) & (n - c >= 5)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(c, 1) + (total - s) ** 2 / np.maximum(n - c, 1) - total**2 / n, -1)
            j = int(np.argmax(gain))
            if gain[j] > 1e-9 and (best is None or gain[j] > best[0] + 1e-12):
                best = float(gain[j]), k, float(own[j])
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each once."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, CUTS))) for k in range(x.shape[1])]
    score = np.zeros(len(x))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        g = y - 1 / (1 + np.exp(-score))
        part = np.sort(rng.choice(len(x), max(2, int(PART * len(x))), replace=False))
        open_: list[tuple[Rule, np.ndarray]] = [((), part)]
        leaves = []
        while open_:
            path, rows = open_.pop()
            found = _split(x[rows], g[rows], cuts) if len(path) < DEPTH and len(rows) >= 10 else None
            if path:
                rules[tuple(sorted(path))] = None
            if not found:
                leaves.append((path, float(g[rows].mean()) if len(rows) else 0.0))
                continue
            _, k, cut = found
            above = x[rows, k] > cut
            open_ += [((*path, (k, True, cut)), rows[above]), ((*path, (k, False, cut)), rows[~above])]
        for path, value in leaves:
            score += RATE * 4 * value * holds(path, x)
    return list(rules)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    n = len(y)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    w, b = np.zeros(r.shape[1]), base
    v, c, t = w.copy(), b, 1.0
    step = 4 * n / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2 + 1e-9)
    for _ in range(rounds):
        e = (1 / (1 + np.exp(-np.clip(r @ v + c, -30, 30))) - y) / n
        nw = v - step * (r.T @ e)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * e.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass
class Ensemble:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            s += w * holds(rule, x)
        return 1 / (1 + np.exp(-s))

    def column(self, stats: dict[str, Column]) -> Column:
        """The probability as a Spark expression."""
        score = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            all_of = F.lit(True)
            for k, greater, cut in rule:
                c = stats[self.names[k]]
                all_of = all_of & (c > F.lit(cut) if greater else c <= F.lit(cut))
            score = score + F.when(all_of, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-score))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{self.names[k]} {'>' if g else '<='} {c:.4g}" for k, g, c in rule) for rule, w in zip(self.rules, self.weights, strict=True)]


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """The lasso penalty is the largest of a grid within one hundredth of the best log loss on every fifth row."""
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 1.0
        return Ensemble(names, [], [], 30.0 if p > 0.5 else -30.0)
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50 or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    rules = tree_rules(x[~held], y[~held])
    r = np.column_stack([holds(rule, x) for rule in rules]).astype(np.float64) if rules else np.zeros((len(y), 0))
    check = held if held.any() else ~held
    tried = []
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, b = lasso_logistic(r[~held], y[~held], penalty)
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-9, 1 - 1e-9)
        tried.append((-float(np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))), w, b))
    least = min(loss for loss, _, _ in tried)
    _, w, b = next(t for t in tried if t[0] <= least + 0.01)
    own = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(names, [rules[k] for k in own], [float(w[k]) for k in own], float(b))


def fit_ensemble(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Ensemble:
    """Fitted on at most so many labelled documents, those whose ids have the smallest hashes."""
    ready(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    known = known.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(most).select("_id", F.col("low").cast("double").alias("y"))
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_id", F.struct("y", *(c.alias(n) for n, c in stats.items())).alias("r")).groupBy("_id").agg(F.min("r").alias("r")).orderBy("_id").collect()
    data = np.array([tuple(r["r"]) for r in rows], np.float64).reshape(len(rows), len(stats) + 1)
    return fit(data[:, 1:], data[:, 0], list(stats))


def score(docs: DataFrame, ensemble: Ensemble, bound: float = BOUND) -> DataFrame:
    """(doc_id, probability, keep) of each document."""
    stats = statistics(F.col("text"))
    named = docs.select("doc_id", *(c.alias(n) for n, c in stats.items()))
    scored = named.select("doc_id", ensemble.column({n: F.col(n) for n in stats}).alias("p"))
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.round("p", 6).alias("probability"), (F.col("p") >= bound).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS, bound: float = BOUND) -> DataFrame:
    return score(docs, fit_ensemble(docs, labels, most), bound)
