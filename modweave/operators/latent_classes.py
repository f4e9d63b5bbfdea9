"""Latent-class mixtures of categorical and continuous columns: fitting, selection, pruning, imputation.

The data stay a DataFrame with ``row_ord``, ``cats`` (array of int) and ``meth`` (array of double), nulls
allowed inside. The driver holds parameters only; each iteration is one aggregate over the rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Params:
    """``pi[c]``, ``phi[c][k][j]``, ``mean[c][m]``, ``var[c][m]``."""

    pi: list[float]
    phi: list[list[list[float]]]
    mean: list[list[float]]
    var: list[list[float]]

    @property
    def classes(self) -> int:
        return len(self.pi)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Params:
        return cls(**json.loads(text))


@dataclass(frozen=True)
class Priors:
    alpha_pi: float = 1.0
    alpha_phi: float = 1.0


def _log_sum(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def class_logs(p: Params, without: int | None = None) -> Column:
    """log of prior times density of each class; missing cells are left out, and dimension ``without``."""
    logs = []
    for c in range(p.classes):
        total = F.lit(math.log(max(p.pi[c], 1e-300)))
        for k, phi in enumerate(p.phi[c]):
            table = F.array(*(F.lit(math.log(max(v, 1e-300))) for v in phi))
            total = total + F.coalesce(F.try_element_at(table, F.col("cats")[k] + 1), F.lit(0.0))
        for m, (mu, var) in enumerate(zip(p.mean[c], p.var[c])):
            if m != without:
                v = max(var, 1e-12)
                d = F.col("meth")[m] - F.lit(mu)
                total = total + F.coalesce(F.lit(-0.5 * math.log(2 * math.pi * v)) - d * d / F.lit(2 * v), F.lit(0.0))
        logs.append(total)
    return F.array(*logs)


def e_step(rows: DataFrame, p: Params) -> DataFrame:
    """Adds ``resp`` (array over classes) and ``ll``, the row's log-likelihood."""
    logged = rows.withColumn("logs", class_logs(p)).withColumn("ll", _log_sum(F.col("logs")))
    return logged.withColumn("resp", F.transform("logs", lambda v: F.exp(v - F.col("ll")))).drop("logs")


def statistics(rows: DataFrame, p: Params) -> tuple:
    """Everything that the M step needs, summed in one aggregate: n, ll, per class the weight, and by column its sums."""
    sums = [F.count("*"), F.sum("ll")]
    r = lambda c: F.col("resp")[c]
    for c in range(p.classes):
        sums.append(F.sum(r(c)))
        for k, phi in enumerate(p.phi[c]):
            sums += [F.sum(F.when(F.col("cats")[k] == j, r(c)).otherwise(0.0)) for j in range(len(phi))]
        for m in range(len(p.mean[c])):
            x = F.col("meth")[m]
            # centred at the last mean, so that the variance doesn't cancel
            d = x - F.lit(p.mean[c][m])
            sums += [F.sum(F.when(x.isNotNull(), r(c)).otherwise(0.0)), F.coalesce(F.sum(r(c) * d), F.lit(0.0)), F.coalesce(F.sum(r(c) * d * d), F.lit(0.0))]
    return tuple(rows.agg(*(s.alias(f"s{k}") for k, s in enumerate(sums))).first())


def m_step(stats: tuple, p: Params, priors: Priors) -> Params:
    at = iter(stats)
    n, _ = next(at), next(at)
    pi, phi, mean, var = [], [], [], []
    for c in range(p.classes):
        pi.append((next(at) + priors.alpha_pi) / (n + priors.alpha_pi * p.classes))
        tables = []
        for old in p.phi[c]:
            counts = [next(at) + priors.alpha_phi for _ in old]
            tables.append([x / sum(counts) for x in counts])
        phi.append(tables)
        means, variances = [], []
        for mu in p.mean[c]:
            w, d1, d2 = next(at), next(at), next(at)
            means.append(mu + d1 / w if w > 0 else 0.0)
            variances.append(max(d2 / w - (d1 / w) ** 2, 1e-6) if w > 1e-9 else 1.0)
        mean.append(means)
        var.append(variances)
    return Params(pi, phi, mean, var)


def start(rows: DataFrame, classes: int, levels: list[int], n_meth: int, priors: Priors, seed: int = 0) -> Params:
    """Random start from a seed: uniform pi, Dirichlet phi, means at observed values, sample variances."""
    rng = np.random.default_rng(seed)
    phi = [[rng.dirichlet([priors.alpha_phi] * j).tolist() for j in levels] for _ in range(classes)]
    mean, var = np.zeros((classes, n_meth)), np.ones((classes, n_meth))
    if n_meth:
        told = rows.agg(*(f(F.col("meth")[m]).alias(f"{f.__name__}{m}") for m in range(n_meth) for f in (F.count, F.avg, F.var_samp))).first()
        for m in range(n_meth):
            n, avg, v = told[3 * m : 3 * m + 3]
            var[:, m] = max(v, 1e-6) if v is not None and n > 1 else 1e-6 if n else 1.0
            if not n:
                mean[:, m] = np.linspace(0, 1, classes) if classes > 1 else 0.0
            elif classes == 1:
                mean[0, m] = avg
            else:
                drawn = rows.where(F.col("meth")[m].isNotNull()).orderBy(F.xxhash64("row_ord", F.lit(seed * 1009 + m))).limit(classes).select(F.col("meth")[m]).collect()
                values = [r[0] for r in drawn]
                mean[:, m] = [values[c] if c < len(values) else values[0] + c * 1e-6 for c in range(classes)] if len(values) > 1 else [values[0] + c * 1e-6 for c in range(classes)]
    return Params([1 / classes] * classes, phi, mean.tolist(), var.tolist())


@dataclass
class Fit:
    params: Params
    ll: float
    iterations: int
    converged: bool
    responsibilities: DataFrame


def fit(rows: DataFrame, classes: int, levels: list[int], n_meth: int, priors: Priors = Priors(), iterations: int = 100, tolerance: float = 1e-6, seed: int = 0, begin: Params | None = None) -> Fit:
    """EM until the log-likelihood moves less than ``tolerance``.

    ``ll`` is that of the returned parameters, after the last M step; the responsibilities are those the step was made
    from. A last turn that moves ``ll`` by less counts; without one the count is one above ``iterations``.
    """
    p = begin or start(rows, classes, levels, n_meth, priors, seed)
    held, before, used = rows.persist(), None, p
    try:
        # the sums that the next M step needs hold the log-likelihood as well, so each turn is one pass
        stats = statistics(e_step(held, p), p)
        for turn in range(iterations):
            used, p = p, m_step(stats, p, priors)
            stats = statistics(e_step(held, p), p)
            if before is not None and abs(stats[1] - before) < tolerance:
                return Fit(p, stats[1], turn + 1, True, e_step(rows, used))
            before = stats[1]
    finally:
        held.unpersist()
    return Fit(p, before if before is not None else float("nan"), iterations + 1, False, e_step(rows, used))


def prune(fitted: Fit, least: float) -> Fit:
    """Without classes of a mean responsibility below ``least``; the largest stays if none would (the last of equals).

    ``ll`` becomes that of the parameters that are left.
    """
    means = fitted.responsibilities.agg(*(F.avg(F.col("resp")[c]).alias(f"c{c}") for c in range(fitted.params.classes))).first()
    kept = [c for c, m in enumerate(means) if m >= least] or [max(range(len(means)), key=lambda c: (means[c], c))]
    total = sum(means[c] for c in kept)
    p = fitted.params
    new = Params([means[c] / total for c in kept], [p.phi[c] for c in kept], [p.mean[c] for c in kept], [p.var[c] for c in kept])
    ll = e_step(fitted.responsibilities.drop("resp", "ll"), new).agg(F.sum("ll")).first()[0]
    return Fit(new, ll, fitted.iterations, fitted.converged, fitted.responsibilities.withColumn("resp", renormalised(F.col("resp"), kept)))


def renormalised(resp: Column, kept: list[int]) -> Column:
    own = F.array(*(resp[c] for c in kept))
    total = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
    return F.transform(own, lambda v: F.when(total > 0, v / total).otherwise(F.lit(1.0 / len(kept))))


def parameter_count(classes: int, levels: list[int], n_meth: int) -> int:
    return classes - 1 + classes * sum(j - 1 for j in levels) + 2 * classes * n_meth


def entropy(resp: DataFrame) -> float:
    term = F.aggregate("resp", F.lit(0.0), lambda s, t: s + F.when(t > 0, -t * F.ln(t)).otherwise(0.0))
    return resp.agg(F.sum(term)).first()[0] or 0.0


def score(ll: float, n: int, parameters: int, h: float, criterion: str = "icl", multiplier: float = 2.0) -> float:
    """Lower is better. BIC's penalty is ``multiplier`` times parameters times ln n; ICL adds twice the entropy."""
    bic = -2 * ll + multiplier * parameters * math.log(n)
    return bic if criterion == "bic" else bic + 2 * h


def cv_score(rows: DataFrame, classes: int, levels: list[int], n_meth: int, folds: int = 5, **how) -> float:
    """Minus the held-out log-likelihood per row; folds by row order."""
    n = rows.count()
    folds = min(max(folds, 2), n)
    total = 0.0
    for k in range(folds):
        test = F.col("row_ord") % folds == k
        p = fit(rows.where(~test), classes, levels, n_meth, **how).params
        total += e_step(rows.where(test), p).agg(F.sum("ll")).first()[0] or 0.0
    return -total / n


def pseudo_category(rows: DataFrame, classes: int) -> tuple[DataFrame, list[int]]:
    """Without any haplotype category: one whose level is the row's number modulo the levels."""
    levels = max(classes, 2)
    return rows.withColumn("cats", F.array((F.col("row_ord") % levels).cast("int"))), [levels]


def select_best(rows: DataFrame, lowest: int, highest: int, levels: list[int], n_meth: int, criterion: str = "icl", multiplier: float = 2.0, folds: int = 5, least_weight: float = 0.0, each=None, **how) -> tuple[int, Fit, list[tuple[int, float]]]:
    """The class count of least score, the first of equals, with its fit and all scores. Counts are those asked for.

    ``each`` is called with every count, its fit, its score and the levels it was fitted with.
    """
    best, scores = None, []
    for c in range(lowest, highest + 1):
        data, own = (rows, levels) if levels else pseudo_category(rows, c)
        fitted = fit(data, c, own, n_meth, **how)
        if least_weight > 0:
            fitted = prune(fitted, least_weight)
        if criterion == "cv":
            s = cv_score(data, c, own, n_meth, folds, **how)
        else:
            s = score(fitted.ll, data.count(), parameter_count(c, own, n_meth), entropy(fitted.responsibilities), criterion, multiplier)
        scores.append((c, s))
        if each is not None:
            each(c, fitted, s, own)
        if best is None or s < best[0]:
            best = (s, c, fitted)
    return best[1], best[2], scores


def argmax_first(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def map_assignments(resp: DataFrame) -> DataFrame:
    return resp.select("id", argmax_first(F.col("resp")).alias("assigned_class"), F.array_max("resp").alias("max_probability"))


def impute(rows: DataFrame, p: Params) -> DataFrame:
    """Missing categories by the likeliest level, missing numbers by the classes' means; observed cells stay.

    A number's own dimension doesn't weigh its classes.
    """
    resp = lambda without=None: F.transform(l := class_logs(p, without), lambda v: F.exp(v - _log_sum(l)))  # noqa: E731, E741
    done = rows.withColumn("resp", resp())
    cats = []
    for k in range(len(p.phi[0])):
        chances = F.array(*(sum((F.col("resp")[c] * p.phi[c][k][j] for c in range(p.classes)), F.lit(0.0)) for j in range(len(p.phi[0][k]))))
        cats.append(F.coalesce(F.col("cats")[k], argmax_first(chances)))
    meth = []
    for m in range(len(p.mean[0])):
        own = resp(m)
        meth.append(F.coalesce(F.col("meth")[m], sum((own[c] * p.mean[c][m] for c in range(p.classes)), F.lit(0.0))))
    kind = lambda x, t: F.array(*x).cast(t) if x else F.array().cast(t)
    # other names first: a name inside a lambda would find the new column of the same name
    filled = done.withColumns({"filled_cats": kind(cats, "array<int>"), "filled_meth": kind(meth, "array<double>")}).drop("resp", "cats", "meth")
    return filled.withColumnsRenamed({"filled_cats": "cats", "filled_meth": "meth"})
