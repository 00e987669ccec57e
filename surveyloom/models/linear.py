"""Cross products of a design, aliased columns and collinearity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.models.design import Term, design_columns

ALIAS_TOLERANCE = 1e-9


def cross_products(df: DataFrame, columns: Sequence[Column], weight: Column) -> np.ndarray:
    """X'WX of an intercept and the columns.

    Every task adds up its own product and emits one small matrix; what
    reaches the driver is the sum, as wide as the model and no larger.
    """
    width = len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = np.column_stack([np.ones(len(batch)), *[batch[f"x{i}"] for i in range(width - 1)]])
                total += (x * batch["w"].to_numpy()[:, None]).T @ x
        row, column = np.indices((width, width))
        yield pd.DataFrame({"i": row.ravel(), "j": column.ravel(), "v": total.ravel()})

    named = [column.cast("double").alias(f"x{i}") for i, column in enumerate(columns)]
    cells = (df.select(*named, weight.cast("double").alias("w"))
             .mapInPandas(partial, "i int, j int, v double")
             .groupBy("i", "j").agg(F.sum("v").alias("v")).collect())
    product = np.zeros((width, width))
    for cell in cells:
        product[cell.i, cell.j] = cell.v
    return product


def independent_columns(product: np.ndarray, tolerance: float = ALIAS_TOLERANCE) -> list[int]:
    """Positions of the design columns that earlier columns do not determine.

    ``product`` comes from :func:`cross_products`; position 0 is its first
    column after the intercept.
    """
    centred = product[1:, 1:] - np.outer(product[0, 1:], product[0, 1:]) / product[0, 0]
    scale = np.sqrt(np.maximum(np.diag(centred), 0.0))
    varies = scale > 1e-7 * np.sqrt(np.diag(product)[1:])
    kept: list[int] = []
    for j in np.flatnonzero(varies):
        trial = [*kept, int(j)]
        block = centred[np.ix_(trial, trial)] / np.outer(scale[trial], scale[trial])
        explained = (block[-1, :-1] @ np.linalg.solve(block[:-1, :-1], block[:-1, -1])) if kept else 0.0
        if 1.0 - explained > tolerance:
            kept = trial
    return kept


def vif_from(product: np.ndarray, groups: dict[str, list[int]]) -> list[tuple[str, int, float, float]]:
    """Generalised variance inflation per term: ``term, df, gvif, gvif^(1/(2 df))``.

    ``groups`` gives the design column positions of each term.
    """
    covariance = np.linalg.inv(product)[1:, 1:]
    spread = np.sqrt(np.diag(covariance))
    correlation = covariance / np.outer(spread, spread)
    whole = np.linalg.det(correlation)
    rows = []
    for term, inside in groups.items():
        outside = [j for j in range(len(correlation)) if j not in inside]
        value = (np.linalg.det(correlation[np.ix_(inside, inside)])
                 * (np.linalg.det(correlation[np.ix_(outside, outside)]) if outside else 1.0) / whole)
        rows.append((term, len(inside), float(value), float(value ** (1 / (2 * len(inside))))))
    return rows


def column_groups(terms: Sequence[Term], kept: Sequence[str]) -> dict[str, list[int]]:
    """Positions of the kept design columns by term; terms without any are left out."""
    place = {name: i for i, name in enumerate(kept)}
    groups = {term.name: [place[n] for n in term.contrast_names() if n in place] for term in terms}
    return {name: inside for name, inside in groups.items() if inside}


VIF_SCHEMA = "term string, df int, gvif double, gvif_adjusted double"


def vif_linear(df: DataFrame, terms: Sequence[Term], weight: Column | None = None) -> DataFrame:
    """Variance inflation of the predictors of a linear model."""
    columns = design_columns(terms)
    product = cross_products(df, list(columns.values()), F.lit(1.0) if weight is None else weight)
    return df.sparkSession.createDataFrame(vif_from(product, column_groups(terms, list(columns))), VIF_SCHEMA)
