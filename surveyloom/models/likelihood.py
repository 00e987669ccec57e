"""Many logistic likelihoods climbed side by side, one scan of the data for a step of all of them."""

from __future__ import annotations

import warnings
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.sources.scratch import settle

MAX_STEPS = 25
# A climb ends when the next step would lower the deviance by less than this share.
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Point:
    """Where a likelihood is wanted: coefficients of some columns of the design; column 0 is the intercept."""

    columns: np.ndarray
    beta: np.ndarray


@dataclass(frozen=True)
class Height:
    deviance: float
    gradient: np.ndarray
    information: np.ndarray   # X'WX


Climb = Generator[Point, Height, object]


# Rows from which on another task is worth while.
LEAST_ROWS = 500


def spread(patterns: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """The design as numbers x0, x1, ..., weight and positive, written in as many parts as the session has tasks for."""
    rows = patterns.count()
    parts = min(int(patterns.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(rows // LEAST_ROWS, 1))
    numbers = [c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]
    return settle(patterns.select(*numbers, "weight", "positive").repartition(parts))


def heights(design: DataFrame, points: Sequence[Point]) -> list[Height]:
    """Deviance, gradient and information at every point, in one scan of a table from ``spread``.

    Every task adds up its rows for all points; what reaches the driver is as
    wide as the models and no longer than the points.  Deviances are those of single rows.
    """
    width = len(design.columns) - 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 + len(p.beta) * (1 + len(p.beta))) for p in points]
        for batch in batches:
            if not len(batch):
                continue
            x = np.column_stack([np.ones(len(batch)), batch[[f"x{i}" for i in range(width)]].to_numpy(np.float64)])
            n, y = batch["weight"].to_numpy(), batch["positive"].to_numpy()
            for total, point in zip(sums, points):
                mine = x[:, point.columns]
                linear = mine @ point.beta
                p = 1 / (1 + np.exp(-np.clip(linear, -700, 700)))
                total[0] += 2 * (y @ np.logaddexp(0, -linear) + (n - y) @ np.logaddexp(0, linear))
                total[1:1 + len(point.beta)] += mine.T @ (y - n * p)
                total[1 + len(point.beta):] += ((mine * (n * p * (1 - p))[:, None]).T @ mine).ravel()
        yield pd.DataFrame({"point": np.arange(len(points)), "sums": sums})

    found = (design.mapInPandas(partial, "point int, sums array<double>").select("point", F.posexplode("sums").alias("at", "v"))
             .groupBy("point", "at").agg(F.sum("v").alias("v")).toArrow())
    sums = [np.zeros(1 + len(p.beta) * (1 + len(p.beta))) for p in points]
    for point, at, value in zip(*(found.column(name).to_numpy() for name in ("point", "at", "v"))):
        sums[point][at] = value
    return [Height(float(s[0]), s[1:1 + len(p.beta)], s[1 + len(p.beta):].reshape(len(p.beta), -1)) for s, p in zip(sums, points)]


def climb_all(design: DataFrame, climbs: Sequence[Climb]) -> list:
    """Run all climbs in step until the last one has ended; their results in order."""
    results: list = [None] * len(climbs)
    asking: dict[int, Point] = {}

    def go(i: int, height: Height | None) -> None:
        try:
            asking[i] = climbs[i].send(height)
        except StopIteration as end:
            asking.pop(i, None)
            results[i] = end.value

    for i in range(len(climbs)):
        go(i, None)
    while asking:
        asked = list(asking.items())
        for (i, _), height in zip(asked, heights(design, [point for _, point in asked])):
            go(i, height)
    return results


@dataclass(frozen=True)
class Peak:
    beta: np.ndarray
    deviance: float
    covariance: np.ndarray    # of the free coefficients


def newton(columns: np.ndarray, start: np.ndarray, held: int | None = None) -> Generator[Point, Height, Peak]:
    """Climb from ``start`` to the best coefficients, one of which may be held."""
    free = np.array([i for i in range(len(columns)) if i != held], dtype=int)
    beta, last, before = start.astype(float), None, np.inf
    for _ in range(MAX_STEPS):
        height = yield Point(columns, beta)
        if last is not None and not height.deviance <= before + 1e-8 * abs(before):
            beta = (beta + last) / 2  # too far
            continue
        information = height.information[np.ix_(free, free)]
        step = np.linalg.lstsq(information, height.gradient[free], rcond=None)[0] if len(free) else np.zeros(0)
        gain = float(height.gradient[free] @ step)
        last, before = beta, height.deviance
        beta = beta.copy()
        beta[free] += step
        if gain <= TOLERANCE * (abs(height.deviance) + 0.1):
            break
    else:
        warnings.warn(f"the fit did not converge in {MAX_STEPS} steps", RuntimeWarning, stacklevel=2)
    return Peak(beta, before - gain, np.linalg.pinv(information, hermitian=True) if len(free) else np.zeros((0, 0)))


def root(inner: float, outer: float, f_inner: float, tolerance: float = 1e-5, steps: int = 30,
         widenings: int = 8) -> Generator[float, float, float]:
    """Where a function reaches 0, asked for its values: secant steps kept inside a widening-then-shrinking bracket.

    Infinite on the side where no bracket is found, as for a coefficient that
    separates the classes; NaN if the steps do not converge.
    """
    f_outer = yield outer
    while f_outer < 0:
        if not widenings:
            return float(np.copysign(np.inf, outer - inner))
        widenings -= 1
        inner, f_inner, outer = outer, f_outer, outer + 2 * (outer - inner)
        f_outer = yield outer
    for _ in range(steps):
        middle = inner - f_inner * (outer - inner) / (f_outer - f_inner)
        f_middle = yield middle
        if abs(f_middle) < tolerance:
            return middle
        if f_middle < 0:
            inner, f_inner = middle, f_middle
        else:
            outer, f_outer = middle, f_middle
    return float("nan")


def profile_end(columns: np.ndarray, peak: Peak, place: int, side: int, z: float) -> Generator[Point, Height, float]:
    """The value of one coefficient, on one side, where the best fit with it is ``z`` standard normal units off.

    Newton steps towards the point where the deviance has grown by z * z and the
    other coefficients are at their best; where those lead astray, the root is
    bracketed, with a climb of the others at each value.
    """
    error = np.sqrt(peak.covariance[place, place])
    along = peak.covariance[:, place] / peak.covariance[place, place]
    others = np.array([i for i in range(len(columns)) if i != place], dtype=int)
    target, centre = peak.deviance + z * z, peak.beta[place]

    def guess(value: float) -> np.ndarray:
        return peak.beta + along * (value - centre)

    beta = guess(centre + side * z * error)
    for _ in range(8):
        height = yield Point(columns, beta)
        system = np.vstack([height.information[others], -2 * height.gradient])
        wanted = np.append(height.gradient[others], target - height.deviance)
        step = np.linalg.lstsq(system, wanted, rcond=None)[0]
        if not np.isfinite(step).all() or abs(step[place]) > z * error:
            break
        beta = beta + step
        if (beta[place] - centre) * side <= 0:
            break
        if abs(step[place]) < 1e-7 * error and abs(target - height.deviance) < 1e-6 * z * z:
            return float(beta[place])
    search = root(centre, centre + side * z * error, -z)
    value = next(search)
    while True:
        held = guess(value)
        best = yield from newton(columns, held, place)
        try:
            value = search.send(float(np.sqrt(max(best.deviance - peak.deviance, 0.0)) - z))
        except StopIteration as end:
            return end.value
