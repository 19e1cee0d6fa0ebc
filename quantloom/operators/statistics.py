"""Scalars of the multiple-testing statistics; they depend on counts, not on rows."""

from __future__ import annotations

import math
from statistics import NormalDist

_EULER = 0.5772156649015329
#: The variance of an annualised ratio of daily bars grows by its square over this: twice the bars of a year.
SQUARED = 2 * 252
_normal = NormalDist()


def expected_max_sharpe(dispersion: float, n_trials: int) -> float:
    """Expected best of n_trials skill-less Sharpe ratios."""
    if n_trials <= 1:
        return 0.0
    return dispersion * ((1 - _EULER) * _normal.inv_cdf(1 - 1 / n_trials) + _EULER * _normal.inv_cdf(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(sharpe: float, benchmark: float, n: int, skew: float, kurtosis: float) -> float:
    """Probability that the true (per-bar) Sharpe ratio exceeds the benchmark."""
    spread = 1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe**2
    if n < 2 or spread <= 0:
        raise ValueError("the standard error cannot be measured")
    return _normal.cdf((sharpe - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def minimum_backtest_years(sharpe: float, n_trials: int) -> float:
    return 2 * math.log(n_trials) / sharpe**2 if sharpe > 0 else math.inf


def null_bar(years: float, n: int) -> float:
    return math.sqrt(1 / years) * math.sqrt(2 * math.log(n)) if n >= 2 and years > 0 else 0.0


def standard_error(sharpe: float, years: float) -> float:
    """Of an annualised Sharpe ratio that was measured over so many years of daily bars."""
    return math.sqrt((1 + sharpe**2 / SQUARED) / years)


def detectable_sharpe(n_trials: int, years: float, power: float = 0.8) -> float:
    """Smallest true Sharpe ratio found with this power, by fixed-point iteration."""
    bar = null_bar(years, n_trials)
    found = bar
    for _ in range(8):
        found = bar + _normal.inv_cdf(power) * standard_error(found, years)
    return found


def quantile(p: float) -> float:
    """Of the standard normal distribution."""
    return _normal.inv_cdf(p)
