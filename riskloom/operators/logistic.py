"""L2 logistic regression by Newton steps whose convergence is checked.

Minimised is ``sum(w * log(1 + exp(-margin))) + |coef|^2 / (2 C)`` with balanced class weights; the intercept is
free.  Rows are first reduced to distinct feature vectors with their counts per class (binned features repeat
a lot), written once; every pass over that table adds up the loss, the gradient and the Gram matrix in the tasks
and combines them per matrix cell, so the driver sees ``(k + 1)(k + 4) / 2 + 1`` numbers for k features whatever
the number of rows.

Defined results: a null feature counts as 0, rows without a label are left out, equal rows count as often as they
occur; a label of one class only, an empty table, and a fit that does not converge raise ``ValueError``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.store import spill

#: Largest component of the gradient, per row, that counts as zero.
TOLERANCE = 1e-9


def vectors(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """x0.., good, bad: distinct feature vectors with their rows per class."""
    known = df.where(F.col(label).isNotNull())
    return (known.groupBy(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)])
            .agg(F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col(label) != 0, 1).otherwise(0)).alias("bad")))


def _sums(x: np.ndarray, good: np.ndarray, bad: np.ndarray, beta: np.ndarray, weight: tuple[float, float]) -> np.ndarray:
    """Loss, gradient and upper triangle of the Gram matrix of weighted rows, in one vector."""
    margin = x @ beta
    p = np.exp(-np.logaddexp(0.0, -margin))
    g, b = weight[0] * good, weight[1] * bad
    loss = g @ np.logaddexp(0.0, margin) + b @ np.logaddexp(0.0, -margin)
    gradient = x.T @ ((g + b) * p - b)
    gram = (x * ((g + b) * p * (1.0 - p))[:, None]).T @ x
    return np.concatenate([[loss], gradient, gram[np.triu_indices(len(beta))]])


def derivatives(table: DataFrame, k: int, beta: np.ndarray, weight: tuple[float, float], ridge: float):
    """(objective, gradient, Hessian) at ``beta`` (intercept first): one pass over the distinct vectors."""
    def run(batches):
        total = np.zeros(1 + (k + 1) + (k + 1) * (k + 2) // 2)
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), *[pdf[f"x{i}"].to_numpy(float) for i in range(k)]])
            total += _sums(x, pdf["good"].to_numpy(float), pdf["bad"].to_numpy(float), beta, weight)
        yield pd.DataFrame({"cell": np.arange(len(total)), "value": total})

    cells = table.mapInPandas(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(1 + (k + 1) + (k + 1) * (k + 2) // 2)
    for c in cells:
        total[c["cell"]] = c["value"]
    held = np.r_[0.0, np.full(k, ridge)]
    hessian = np.zeros((k + 1, k + 1))
    hessian[np.triu_indices(k + 1)] = total[k + 2:]
    hessian = hessian + np.triu(hessian, 1).T + np.diag(held)
    return total[0] + 0.5 * held @ beta ** 2, total[1:k + 2] + held * beta, hessian


def newton(table: DataFrame, k: int, weight: tuple[float, float], n: float, C: float = 1.0, max_iter: int = 100,
           tolerance: float = TOLERANCE) -> dict:
    """Coefficients (intercept first) where the gradient vanishes; steps are halved until the objective falls enough."""
    beta = np.zeros(k + 1)
    value, gradient, hessian = derivatives(table, k, beta, weight, 1.0 / C)
    passes = 1
    while (norm := float(np.abs(gradient).max()) / n) > tolerance:
        step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        slope, share = float(gradient @ step), 1.0
        while True:
            if passes >= max_iter:
                raise ValueError(f"logistic fit has not converged after {passes} passes: gradient {norm:.3g} a row")
            passes += 1
            trial = derivatives(table, k, beta + share * step, weight, 1.0 / C)
            if trial[0] <= value + 1e-4 * share * slope + 1e-13 * abs(value):
                break
            share /= 2
        beta = beta + share * step
        value, gradient, hessian = trial
    return {"beta": beta, "objective": value, "gradient_norm": norm, "passes": passes}


def fit(df: DataFrame, columns: list[str], label: str, C: float = 1.0, max_iter: int = 100) -> dict:
    """intercept, coefficients (in the order of ``columns``), gradient norm per row, passes over the vectors."""
    table = spill(vectors(df, columns, label), "logistic")
    good, bad = (float(v or 0) for v in table.agg(F.sum("good"), F.sum("bad")).first())
    if not good or not bad:
        raise ValueError("a logistic fit needs rows of both classes")
    n = good + bad
    found = newton(table, len(columns), (n / (2 * good), n / (2 * bad)), n, C, max_iter)
    return {"intercept": float(found["beta"][0]), "coef": [float(v) for v in found["beta"][1:]],
            "gradient_norm": found["gradient_norm"], "passes": found["passes"]}
