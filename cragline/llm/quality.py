"""Quality scores from a sparse ensemble of rules.

Statistics of a text are Spark column expressions. Small regression trees are grown on them one after
another, each on the residuals of those before; the path to every tree node is a rule, a conjunction of
threshold tests. A logistic model with an L1 penalty keeps few of the rules. These are compiled back
into Spark columns, so that scoring runs no Python.

Training reads labelled rows only, at most about ``BOUND`` of them, chosen by hash.

Cases: null and empty texts have all statistics 0 and are scored like any text; labels for unknown ids
are not used; several labels of one id count as their largest; without labels of both kinds the score is
the share of label 1 (0.5 with none); rows with null ids are scored and never learned from; repeated rows
get equal scores; very long texts are counted whole; extra columns pass by whatever they are called, but for one named like the score, which is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod

#: Labelled rows to learn from, at most.
BOUND = 6000
TREES, DEPTH, BINS, SHRINK, PENALTY = 24, 3, 24, 0.3, 0.004
#: A score from which on a text is taken as good.
CUT = 0.3

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, above, threshold), all of which hold


def statistics(text: Column) -> dict[str, Column]:
    """Columns over the whole text; each is 0 for a text without words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    return {
        "_chars": F.length(text).cast("double"),
        "_words": F.size(words).cast("double"),
        "_distinct": F.size(F.array_distinct(words)).cast("double"),
        "_lines": F.size(lines).cast("double"),
        "_distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "_letters": F.regexp_count(text, F.lit(r"\p{L}")).cast("double"),
        "_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("double"),
        "_digits": F.regexp_count(text, F.lit(r"[0-9]")).cast("double"),
        "_signs": F.regexp_count(text, F.lit(r"[^\p{L}0-9\s.,;:'\"()-]")).cast("double"),
        "_stops": F.regexp_count(text, F.lit(r"[.,;:]")).cast("double"),
    }


def ratios() -> dict[str, Column]:
    """The statistics that rules test, made from the counts."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.log1p("_words"), "distinct_words": over("_distinct", "_words"), "root_distinct": F.when(F.col("_words") > 0, F.col("_distinct") / F.sqrt("_words")).otherwise(F.lit(0.0)),
        "word_length": over("_chars", "_words"), "line_words": over("_words", "_lines"), "distinct_lines": over("_distinct_lines", "_lines"), "letters": over("_letters", "_chars"),
        "upper": over("_upper", "_letters"), "digits": over("_digits", "_chars"), "signs": over("_signs", "_words"), "stops": over("_stops", "_words"),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, so that none can clash) and the statistics of its text."""
    counted = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in statistics(F.coalesce(F.col("text"), F.lit(""))).items()))
    return counted.select("row", *(c.alias(f"_s_{k}") for k, c in ratios().items()))


def grow(binned: np.ndarray, residual: np.ndarray, rows: np.ndarray, depth: int) -> list[list[tuple[int, bool, int]]]:
    """Paths to all nodes of a tree: (feature, above, bin) tests."""
    if depth == 0 or len(rows) < 20:
        return []
    best, y = (1e-9, -1, -1), residual[rows]
    for f in range(binned.shape[1]):
        n, s = (np.bincount(binned[rows, f], w, minlength=BINS + 1).cumsum() for w in (None, y))
        left, right = n[:-1], len(rows) - n[:-1]
        ok = (left >= 5) & (right >= 5)
        gain = np.where(ok, s[:-1] ** 2 / np.maximum(left, 1) + (s[-1] - s[:-1]) ** 2 / np.maximum(right, 1), -1) - s[-1] ** 2 / len(rows)
        if gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    _, f, b = best
    if f < 0:
        return []
    out = []
    for above in (False, True):
        head = (f, above, b)
        out += [[head], *([head, *p] for p in grow(binned, residual, rows[(binned[rows, f] > b) == above], depth - 1))]
    return out


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; the intercept isn't penalised."""
    n, step = len(y), 4.0 / max(1e-9, np.linalg.norm(np.c_[x, np.ones(len(y))], 2) ** 2 / len(y))
    w = v = np.zeros(x.shape[1] + 1)
    ones, t = np.c_[x, np.ones(n)], 1.0
    for _ in range(steps):
        gradient = ones.T @ (1 / (1 + np.exp(-(ones @ v))) - y) / n
        nxt = v - step * gradient
        nxt[:-1] = np.sign(nxt[:-1]) * np.maximum(np.abs(nxt[:-1]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = nxt + (before - 1) / t * (nxt - w), nxt
    return w[:-1], float(w[-1])


class RuleModel:
    """Rules with weights, and an intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self) -> Column:
        """The chance of label 1, over the columns of ``with_statistics``."""
        test = lambda name, above, at: F.col(f"_s_{name}") > at if above else F.col(f"_s_{name}") <= at
        parts = [F.when(reduce(and_, (test(*t) for t in rule)), F.lit(w)).otherwise(F.lit(0.0)) for rule, w in self.rules]
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, parts, F.lit(self.intercept))))


def fit_rules(names: list[str], x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return RuleModel([], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    rng, raw, found = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-raw))
        paths = grow(binned, residual, rng.permutation(len(y))[: max(200, len(y) * 2 // 3)], DEPTH)
        for p in paths:
            holds = np.all([(binned[:, f] > b) == above for f, above, b in p], 0)
            found.setdefault(tuple(sorted(p)), holds)
            if holds.any():
                raw = raw + SHRINK / DEPTH * residual[holds].mean() / max(0.05, (np.abs(residual[holds]) * (1 - np.abs(residual[holds]))).mean()) * holds
    paths = [p for p, h in found.items() if 0 < h.sum() < len(y) and all(b < len(edges[f]) for f, _, b in p)]
    matrix = np.stack([found[p] for p in paths], 1).astype(float)
    w, intercept = lasso_logistic(matrix, y, PENALTY)
    return RuleModel([(tuple((names[f], above, float(edges[f][b])) for f, above, b in p), float(v)) for p, v in zip(paths, w, strict=True) if abs(v) > 1e-6], intercept)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", bound: int = BOUND) -> RuleModel:
    """Learns from the rows of labels (doc_id, column): at most about bound of them."""
    known = bounded_sample(labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).alias("_y")), bound, 8, "doc_id")
    known = known.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))  # bounded above
    names = list(ratios())
    # a bound on ids is none on rows if ids repeat
    told = rows.select("row.doc_id", "row._y", *(f"_s_{n}" for n in names))
    got = told.orderBy(*told.columns).limit(4 * bound).drop("doc_id").toPandas().to_numpy(float)
    got = got[np.lexsort(got.T)] if len(got) else got.reshape(0, len(names) + 1)
    return fit_rules(names, got[:, 1:], (got[:, 0] > 0).astype(float))


def score(docs: DataFrame, model: RuleModel, to: str = "score") -> DataFrame:
    """docs with a column of the chance of label 1."""
    scored = with_statistics(docs.drop(to))
    return scored.select("row.*", model.score().alias(to))


def accepted(docs: DataFrame, model: RuleModel, cut: float = CUT) -> DataFrame:
    """The rows of docs with scores from cut on."""
    return with_statistics(docs).where(model.score() >= cut).select("row.*")


def training_labels(labels: DataFrame, folds: int, held_out: int) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), folds) != held_out)


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    scored = score(docs, fit(docs, training_labels(labels, 5, 0)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
