"""Exact (Clopper-Pearson) binomial intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def _bounds_udf():
    """Vectorised bounds: each distinct (wins, trials, alpha) of a batch is solved once, by bisection
    on the regularised incomplete beta function."""

    @F.pandas_udf("lo double, hi double")
    def bounds(wins: pd.Series, trials: pd.Series, alpha: pd.Series) -> pd.DataFrame:
        import math

        import numpy as np

        def log_gamma(x):
            return np.array([math.lgamma(v) for v in x])

        def continued_fraction(a, b, x):
            tiny = 1e-300
            c = np.ones_like(x)
            d = 1.0 - (a + b) * x / (a + 1.0)
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            total = d.copy()
            # The fraction needs about sqrt(a + b) terms.
            for m in range(1, 200 + int(12 * math.sqrt(float(np.max(a + b))))):
                for term in (
                    m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
                ):
                    d = 1.0 + term * d
                    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
                    c = 1.0 + term / c
                    c = np.where(np.abs(c) < tiny, tiny, c)
                    step = c * d
                    total *= step
                if np.max(np.abs(step - 1.0)) < 1e-15:
                    break
            return total

        def incomplete_beta(a, b, x, log_norm):
            swap = x > (a + 1.0) / (a + b + 2.0)
            p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
            with np.errstate(divide="ignore"):
                front = np.exp(log_norm + p * np.log(y) + q * np.log1p(-y)) / p
            value = front * continued_fraction(p, q, y)
            return np.where(swap, 1.0 - value, value)

        def quantile(probability, a, b):
            log_norm = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
            lo, hi = np.zeros_like(a), np.ones_like(a)
            for _ in range(60):
                mid = (lo + hi) / 2.0
                below = incomplete_beta(a, b, mid, log_norm) < probability
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
            return (lo + hi) / 2.0

        cases = np.stack([wins.to_numpy(float), trials.to_numpy(float), alpha.to_numpy(float)])
        out_lo, out_hi = np.full(cases.shape[1], np.nan), np.full(cases.shape[1], np.nan)
        usable = ~np.isnan(cases).any(axis=0)
        if usable.any():
            (k, n, al), inverse = np.unique(cases[:, usable], axis=1, return_inverse=True)
            inverse = np.ravel(inverse)
            lo, hi = np.zeros_like(k), np.ones_like(k)
            some, open_top = k > 0, k < n
            if some.any():
                lo[some] = quantile(al[some] / 2.0, k[some], n[some] - k[some] + 1.0)
            if open_top.any():
                hi[open_top] = quantile(1.0 - al[open_top] / 2.0, k[open_top] + 1.0, n[open_top] - k[open_top])
            out_lo[usable], out_hi[usable] = lo[inverse], hi[inverse]
        frame = pd.DataFrame({"lo": out_lo, "hi": out_hi})
        return frame.astype(object).where(frame.notna(), None).astype("Float64")

    return bounds


def exact_interval(wins: Column, trials: Column, alpha: Column) -> Column:
    """Struct `lo`, `hi` of the exact interval; nulls stay null."""
    return _bounds_udf()(wins.cast("double"), trials.cast("double"), alpha.cast("double"))
