"""Logistic regression on counted answer patterns, with its diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.models.design import Term, design_columns
from surveyloom.models.likelihood import Peak, climb_all, newton, profile_end, spread
from surveyloom.models.linear import VIF_SCHEMA, column_groups, cross_products, independent_columns, vif_from

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Logit:
    """A fitted model: estimates and standard errors by design column, intercept first."""

    terms: tuple[Term, ...]
    estimates: dict[str, float]
    errors: dict[str, float]
    aliased: tuple[str, ...]
    deviance: float
    null_deviance: float
    rows: float
    covariance: np.ndarray = field(compare=False)

    @property
    def rank(self) -> int:
        return len(self.estimates)

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.rank

    def peak(self) -> Peak:
        return Peak(np.array(list(self.estimates.values())), self.deviance, self.covariance)

    def probability(self) -> Column:
        """P(positive) as an expression; NULL where an answer is missing or not a declared level."""
        columns = design_columns(self.terms)
        linear = reduce(Column.__add__, [columns[name] * F.lit(value) for name, value in self.estimates.items()
                                         if name != INTERCEPT], F.lit(self.estimates[INTERCEPT]))
        usable = reduce(Column.__and__, [term.usable() for term in self.terms], F.lit(True))
        return F.when(usable, 1 / (1 + F.exp(-linear)))


def _entropy(positive: Column, total: Column) -> Column:
    """-2 log likelihood of each pattern at its own share of positives."""
    def part(n: Column) -> Column:
        return F.when(n > 0, n * F.ln(n / total)).otherwise(0.0)
    return -2 * (part(positive) + part(total - positive))


@dataclass(frozen=True)
class Measures:
    """What all fits to one table of patterns share."""

    columns: dict[str, Column]
    design: DataFrame
    products: np.ndarray     # X'WX of the intercept and the named columns
    rows: float
    positive: float
    null_deviance: float

    def independent(self, terms: Sequence[Term]) -> list[str]:
        """Design columns of the terms that are not determined by earlier ones."""
        mine = [name for term in terms for name in term.contrast_names()]
        place = self.places([INTERCEPT, *mine])
        return [mine[i] for i in independent_columns(self.products[np.ix_(place, place)])]

    def places(self, names: Sequence[str]) -> np.ndarray:
        order = {name: i for i, name in enumerate([INTERCEPT, *self.columns])}
        return np.array([order[name] for name in names], dtype=int)


def measure(patterns: DataFrame, terms: Sequence[Term]) -> Measures:
    columns = design_columns(terms)
    products = cross_products(patterns, list(columns.values()), F.col("weight"))
    n, p = F.sum("weight"), F.sum("positive")
    row = patterns.agg(n.alias("n"), p.alias("p"), _entropy(p, n).alias("null_deviance")).first()
    return Measures(columns, spread(patterns, list(columns.values())), products, row.n, row.p, row.null_deviance)


def fit_logits(choices: Sequence[Sequence[Term]], measures: Measures, above: Logit | None = None) -> list[Logit]:
    """Fits of several sets of terms to the patterns that were measured, climbed side by side.

    The sets hold any of the measured terms.  ``above``, a fit
    that has all the columns, gives each climb its start: the best point of its
    quadratic shape at which the columns that are left out have no effect.
    """
    names = [[INTERCEPT, *measures.independent(terms)] for terms in choices]
    climbs = []
    for mine in names:
        start = np.zeros(len(mine))
        start[0] = math.log(measures.positive / (measures.rows - measures.positive))
        if above is not None and set(mine) <= set(above.estimates):
            order = list(above.estimates)
            stay, gone = [order.index(n) for n in mine], [i for i, n in enumerate(order) if n not in mine]
            beta, spread = above.peak().beta, above.covariance
            start = beta[stay] - (spread[np.ix_(stay, gone)] @ np.linalg.solve(spread[np.ix_(gone, gone)], beta[gone]) if gone else 0.0)
        climbs.append(newton(measures.places(mine), start))
    peaks = climb_all(measures.design, climbs)
    return [Logit(tuple(terms), dict(zip(mine, peak.beta.tolist())), dict(zip(mine, np.sqrt(np.diag(peak.covariance)).tolist())),
                  tuple(n for term in terms for n in term.contrast_names() if n not in mine), peak.deviance,
                  measures.null_deviance, measures.rows, peak.covariance)
            for terms, mine, peak in zip(choices, names, peaks)]


def fit_logit(patterns: DataFrame, terms: Sequence[Term], measures: Measures | None = None) -> Logit:
    """Fit the share of positives on ``patterns`` (see ``answer_patterns``).

    Design columns that earlier ones determine are dropped before the fit and
    reported as aliased.  Deviances are those of single rows.
    """
    return fit_logits([terms], measures or measure(patterns, terms))[0]


# ---- tables about one fit

def coefficient_table(spark: SparkSession, fit: Logit) -> DataFrame:
    """Estimate, standard error, z and p per coefficient; aliased ones have no estimate."""
    normal = NormalDist()
    rows = [(name, value, fit.errors[name], value / fit.errors[name],
             2 * normal.cdf(-abs(value / fit.errors[name]))) for name, value in fit.estimates.items()]
    rows += [(name, None, None, None, None) for name in fit.aliased]
    return spark.createDataFrame(
        rows, "coefficient string, estimate double, std_error double, z double, p double")


def fit_statistics(spark: SparkSession, fit: Logit) -> DataFrame:
    row = (fit.null_deviance, int(fit.rows) - 1, fit.deviance, int(fit.rows) - fit.rank, fit.aic)
    return spark.createDataFrame(
        [row], "null_deviance double, null_df bigint, deviance double, residual_df bigint, aic double")


def odds_ratios(spark: SparkSession, fit: Logit) -> DataFrame:
    return spark.createDataFrame([(n, math.exp(v)) for n, v in fit.estimates.items()],
                                 "coefficient string, odds_ratio double")


def importance(spark: SparkSession, fit: Logit) -> DataFrame:
    """Absolute z value of every coefficient but the intercept."""
    rows = [(n, abs(v / fit.errors[n])) for n, v in fit.estimates.items() if n != INTERCEPT]
    return spark.createDataFrame(rows, "coefficient string, importance double")


def odds_ratio_limits(spark: SparkSession, fit: Logit, patterns: DataFrame | None = None, level: float = 0.95,
                      method: str = "wald") -> DataFrame:
    """Confidence limits of the odds ratios.

    ``wald`` uses the standard errors; ``profile`` refits the model around
    each coefficient on ``patterns`` and is the likelihood-based interval, the ends
    of all coefficients found side by side.  Its limit is 0 or infinite on a side
    where the likelihood never falls enough, and missing where the search does not converge.
    """
    z = NormalDist().inv_cdf(0.5 + level / 2)
    if method == "wald":
        limits = {n: (v - z * fit.errors[n], v + z * fit.errors[n]) for n, v in fit.estimates.items()}
    elif method == "profile":
        columns = design_columns(fit.terms)
        kept = [name for name in fit.estimates if name != INTERCEPT]
        if not kept:
            raise ValueError("a model of one intercept has no profile")
        every, jobs = np.arange(len(kept) + 1), [(i, side) for i in range(len(kept) + 1) for side in (-1, 1)]
        design = spread(patterns, [columns[name] for name in kept])
        found = climb_all(design, [profile_end(every, fit.peak(), i, side, z) for i, side in jobs])
        ends = dict(zip(jobs, found))
        limits = {name: (ends[i, -1], ends[i, 1]) for i, name in enumerate(fit.estimates)}
    else:
        raise ValueError(f"unknown method {method!r}")
    rows = [(name, *(None if math.isnan(x) else math.exp(x) for x in (low, high)))
            for name, (low, high) in limits.items()]
    return spark.createDataFrame(rows, "coefficient string, lower double, upper double")


def gvif(patterns: DataFrame, fit: Logit) -> DataFrame:
    """Generalised variance inflation factor per term of a fitted model."""
    kept = [name for name in fit.estimates if name != INTERCEPT]
    columns = design_columns(fit.terms)
    p = fit.probability()
    product = cross_products(patterns, [columns[n] for n in kept], F.col("weight") * p * (1 - p))
    return patterns.sparkSession.createDataFrame(vif_from(product, column_groups(fit.terms, kept)), VIF_SCHEMA)


# ---- backward elimination

@dataclass(frozen=True)
class Step:
    dropped: str | None
    aic: float
    deviance: float
    terms: tuple[str, ...]


def eliminate_backward(patterns: DataFrame, terms: Sequence[Term]) -> tuple[Logit, list[Step]]:
    """Drop whole terms as long as that lowers AIC.

    A term that is fully aliased goes first, as it cannot change the fit.  All
    candidates of a round are climbed together from the fit before them.
    """
    measures = measure(patterns, terms)
    current = fit_logit(patterns, terms, measures)
    steps = [Step(None, current.aic, current.deviance, tuple(t.name for t in current.terms))]
    while current.terms:
        idle = [t for t in current.terms if not any(n in current.estimates for n in t.contrast_names())]
        if idle:
            dropped = idle[-1]
            best = replace(current, terms=tuple(t for t in current.terms if t != dropped),
                           aliased=tuple(n for n in current.aliased if n not in dropped.contrast_names()))
        else:
            choices = [tuple(t for t in current.terms if t != drop) for drop in current.terms]
            fits = fit_logits(choices, measures, current)
            place = min(range(len(fits)), key=lambda i: fits[i].aic)
            best, dropped = fits[place], current.terms[place]
            if best.aic >= current.aic + 1e-7:
                break
        current = best
        steps.append(Step(dropped.name, best.aic, best.deviance, tuple(t.name for t in best.terms)))
    return current, steps


def step_table(spark: SparkSession, steps: Sequence[Step]) -> DataFrame:
    rows = [(i, s.dropped, s.aic, s.deviance, list(s.terms)) for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, dropped string, aic double, deviance double, terms array<string>")
