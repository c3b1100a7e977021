"""Quality classification by a sparse ensemble of rules.

Shallow trees, boosted on a bounded sample of labelled rows, give conjunctions of thresholds on
text statistics (every path from the root, also to inner nodes). A logistic model with a lasso
penalty weighs the rules and leaves most at zero; the rest become one Spark column expression, so
scoring all documents is a projection over the statistics, inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

STATISTICS = ("chars", "words", "mean_word", "letters", "upper", "digits", "symbols", "distinct", "lines", "repeated_lines", "line_words", "ends", "longest", "top_run")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_greater, threshold) hold; weight in the logit."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...]


# == statistics
def with_statistics(docs: DataFrame, text_col: str, names: dict[str, str]) -> DataFrame:
    """``docs`` with one double per statistic, all 0 for a text that is null or blank."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words, lines = X.fresh(docs, "quality_word_list"), X.fresh(docs, "quality_line_list")
    d = docs.withColumn(words, F.filter(F.split(t, r"\s+"), lambda w: w != "")).withColumn(lines, F.filter(F.split(t, r"\n+"), lambda w: w != ""))
    n, chars = F.greatest(F.size(words), F.lit(1)), F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / chars
    tab = {
        "chars": F.length(t), "words": F.size(words), "mean_word": (F.length(t) - F.size(words)) / n,
        "letters": share(r"[^\p{L}]+"), "upper": share(r"[^\p{Lu}]+"), "digits": share(r"[^0-9]+"), "symbols": share(r"[\p{L}\p{N}\s.,;:'\"!?-]+"),
        "distinct": F.size(F.array_distinct(words)) / n, "lines": F.size(lines), "repeated_lines": 1 - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_words": n / F.greatest(F.size(lines), F.lit(1)), "ends": share(r"[^.!?]+"),
        "longest": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)),
        "top_run": F.aggregate(words, F.struct(F.lit("").alias("w"), F.lit(0).alias("same")), lambda a, w: F.struct(w.alias("w"), (a["same"] + F.when(a["w"] == w, 1).otherwise(0)).alias("same")), lambda a: a["same"] / n),
    }
    return d.select(*docs.columns, *[F.when(F.size(words) > 0, tab[k].cast("double")).otherwise(0.0).alias(names[k]) for k in STATISTICS])


# == trees and rules
def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, depth: int, least: int, path: tuple, paths: list, value: np.ndarray) -> None:
    best = (1e-9, None)
    gs = g[rows]
    base = gs.sum() ** 2 / len(rows)
    if depth:
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            at = np.searchsorted(c, x[rows, j])  # how many cuts lie below
            cnt, s = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1], np.cumsum(np.bincount(at, gs, len(c) + 1))[:-1]
            rest = len(rows) - cnt
            ok = (cnt >= least) & (rest >= least)
            gain = np.where(ok, s**2 / np.maximum(cnt, 1) + (gs.sum() - s) ** 2 / np.maximum(rest, 1) - base, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, float(c[k])))
    if path:
        paths.append(path)
    if best[1] is None:
        value[rows] = gs.mean()
        return
    j, cut = best[1]
    above = x[rows, j] > cut
    _tree(x, cuts, g, rows[~above], depth - 1, least, (*path, (j, False, cut)), paths, value)
    _tree(x, cuts, g, rows[above], depth - 1, least, (*path, (j, True, cut)), paths, value)


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.004, rounds: int = 400, seed: int = 3) -> Model:
    """Rules from boosted trees on random halves, weighed by proximal gradient steps (FISTA)."""
    n = len(y)
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    start = float(np.log(prior / (1 - prior)))
    if n < 20 or y.min() == y.max():
        return Model(start, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 33))) for j in range(x.shape[1])]
    f, paths = np.full(n, start), []
    for _ in range(trees):
        g = y - 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(rng.random(n) < 0.5)
        if len(rows) < 10:
            continue
        own: list = []
        value = np.zeros(n)
        _tree(x, cuts, g, rows, depth, max(5, n // 500), (), own, value)
        for path in own:
            inside = np.all([(x[:, j] > c) == up for j, up, c in path], axis=0)
            f[inside] += 0.5 * g[inside].mean() if inside.any() else 0
        paths += own
    paths = list(dict.fromkeys(tuple(sorted(p)) for p in paths))
    rule = np.array([np.all([(x[:, j] > c) == up for j, up, c in p], axis=0) for p in paths], float).T
    keep = (rule.mean(0) > 0) & (rule.mean(0) < 1)
    paths, rule = [p for p, k in zip(paths, keep) if k], rule[:, keep]
    w, b = np.zeros(rule.shape[1]), start
    z, zb, t = w.copy(), b, 1.0
    step = 4 * n / max(1e-9, np.linalg.norm(np.column_stack([rule, np.ones(n)]), 2) ** 2)
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-(rule @ z + zb))) - y) / n
        w2 = z - step * (rule.T @ r)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = zb - step * r.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Model(float(b), tuple(Rule(tuple((STATISTICS[j], up, c) for j, up, c in p), float(v)) for p, v in zip(paths, w) if abs(v) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 10_000, **rules) -> Model:
    """A model from at most ``max_rows`` labelled documents, those with the smallest hashes of their ids.

    Rows with a null id or label aren't used; a label that is repeated counts once, documents that
    repeat an id count each. Without labels, or with labels of one kind only, the model is a constant.
    """
    ids, y = X.fresh(docs, "label_id"), X.fresh(docs, "label_value")
    # the bound keeps this side small enough to broadcast
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias(ids), F.col(label_col).cast("double").alias(y)).distinct().orderBy(F.xxhash64(ids), ids, y).limit(max_rows)
    names = {k: X.fresh(docs, k) for k in STATISTICS}
    sample = docs.join(F.broadcast(chosen), docs[id_col] == F.col(ids))
    rows = with_statistics(sample, text_col, names).select(ids, y, *names.values()).toPandas()
    rows = rows.sort_values([ids, y, *names.values()], ignore_index=True)  # not in Spark, which would compute them twice
    return fit_rules(rows[list(names.values())].to_numpy(float), (rows[y] > 0.5).to_numpy(float), **rules)


# == scoring
def probability(model: Model, names: dict[str, str]) -> Column:
    """The model as a column expression over the statistics."""
    logit = F.lit(model.intercept)
    for rule in model.rules:
        tests = [F.col(names[s]) > F.lit(c) if up else F.col(names[s]) <= F.lit(c) for s, up, c in rule.tests]
        every = tests[0]
        for t in tests[1:]:
            every = every & t
        logit = logit + F.when(every, F.lit(rule.weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-logit))


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5, out: tuple[str, str] = ("quality_score", "quality_ok")) -> DataFrame:
    """``docs`` with the probability of good quality and whether it reaches ``threshold``.

    A null, empty or blank text has statistics 0 and is scored by them. Repeated rows are scored
    alike, very long texts whole. The added columns get underscores in front where names clash.
    Empty tables give empty tables.
    """
    names = {k: X.fresh(docs, "quality_" + k) for k in STATISTICS}
    p, ok = (X.fresh(docs, c) for c in out)
    d = with_statistics(docs, text_col, names).withColumn(p, F.round(probability(model, names), 9))
    return d.select(*docs.columns, p, (F.col(p) >= threshold).alias(ok))
