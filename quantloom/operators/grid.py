"""The signal catalog and its parameter grids: small lists, made on the driver."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from collections.abc import Callable

Params = dict[str, float]
#: Category, and for each parameter (default, least, greatest).
CATALOG: dict[str, tuple[str, dict[str, tuple[float, float, float]]]] = {
    "sma": ("Trend", {"fast": (20, 1, 200), "slow": (50, 2, 500)}),
    "momentum": ("Trend", {"lookback": (60, 1, 500), "skip": (5, 0, 60)}),
    "mean_reversion": ("Mean reversion", {"window": (20, 2, 200), "k": (2.0, 0.1, 10.0)}),
    "rsi_mean_reversion": ("Mean reversion", {"window": (14, 2, 100), "oversold": (30.0, 1.0, 49.0), "overbought": (70.0, 51.0, 99.0)}),
    "donchian_breakout": ("Breakout", {"lookback": (20, 2, 200)}),
    "bollinger_bands": ("Mean reversion", {"window": (20, 2, 200), "num_std": (2.0, 0.5, 5.0)}),
    "macd_crossover": ("Trend", {"fast": (12, 1, 200), "slow": (26, 2, 500), "signal": (9, 1, 100)}),
    "keltner_channel": ("Breakout", {"ma": (20, 1, 200), "atr": (14, 2, 100), "multiplier": (2.0, 0.5, 5.0)}),
    "vol_targeted_sma": ("Trend", {"fast": (20, 1, 200), "slow": (50, 2, 500), "vol": (30, 2, 252), "target": (0.15, 0.01, 1.0)}),
    "trend_filtered_mean_reversion": ("Combination", {"z": (20, 2, 100), "threshold": (1.5, 0.5, 4.0), "trend": (100, 20, 400)}),
    "triple_ma_alignment": ("Trend", {"fast": (10, 1, 100), "medium": (30, 2, 200), "slow": (100, 3, 400)}),
    "williams_r": ("Mean reversion", {"window": (14, 2, 200), "oversold": (-80.0, -99.0, -51.0), "overbought": (-20.0, -49.0, -1.0)}),
    "cci": ("Mean reversion", {"window": (20, 2, 200), "threshold": (100.0, 50.0, 300.0)}),
    "stochastic_oscillator": ("Mean reversion", {"k": (14, 2, 200), "d": (3, 1, 50)}),
    "trix": ("Trend", {"window": (15, 2, 200), "signal": (9, 1, 100)}),
    "aroon": ("Trend", {"window": (25, 2, 200)}),
    "chaikin_money_flow": ("Trend", {"window": (20, 2, 200), "threshold": (0.05, 0.01, 0.5)}),
    "vwap_reversion": ("Mean reversion", {"window": (20, 2, 200), "threshold": (0.02, 0.005, 0.2)}),
    "adx": ("Trend", {"window": (14, 2, 100), "threshold": (25.0, 10.0, 60.0)}),
    "connors_rsi": ("Mean reversion", {"window": (2, 2, 50)}),
    "fifty_two_week_high": ("Trend", {"window": (252, 2, 504), "near_high": (0.95, 0.5, 1.0), "near_low": (0.70, 0.1, 0.99)}),
    "ultimate_oscillator": ("Mean reversion", {"oversold": (30.0, 1.0, 49.0), "overbought": (70.0, 51.0, 99.0)}),
    "vol_managed_momentum": ("Trend", {"lookback": (60, 1, 500), "vol": (20, 2, 252), "target": (0.15, 0.01, 1.0)}),
    "residual_momentum": ("Trend", {"lookback": (120, 1, 500), "skip": (20, 0, 60), "mean": (60, 2, 252)}),
    "overnight_gap": ("Mean reversion", {"threshold": (0.02, 0.005, 0.15)}),
    "donchian_atr_trail": ("Breakout", {"entry": (20, 2, 200), "atr": (22, 2, 100), "multiplier": (3.0, 0.5, 10.0)}),
    "squeeze_breakout": ("Breakout", {"window": (20, 2, 200), "bb": (2.0, 0.5, 5.0), "kc": (1.5, 0.5, 5.0)}),
    "atr_channel_breakout": ("Breakout", {"ma": (20, 2, 200), "atr": (14, 2, 100), "multiplier": (2.0, 0.5, 5.0)}),
    "dual_momentum": ("Trend", {"lookback": (120, 1, 500), "trend": (200, 2, 500)}),
    "regime_filtered_trend": ("Combination", {"fast": (20, 1, 200), "slow": (50, 2, 500), "window": (14, 2, 100), "threshold": (25.0, 10.0, 60.0)}),
    "coppock_curve": ("Trend", {"long": (14, 2, 300), "short": (11, 1, 300), "wma": (10, 2, 100)}),
    "true_strength_index": ("Trend", {"long": (25, 2, 200), "short": (13, 1, 100)}),
    "chande_momentum": ("Mean reversion", {"window": (14, 2, 200), "threshold": (50.0, 10.0, 90.0)}),
    "narrow_range_breakout": ("Breakout", {"window": (7, 2, 60)}),
}
#: Parameters that must increase strictly, in this order.
ORDERED = (("fast", "slow"), ("fast", "medium", "slow"), ("z", "trend"), ("short", "long"), ("near_low", "near_high"))


def valid(name: str, params: Params) -> bool:
    for chain in ORDERED:
        if chain == ("short", "long") and name != "coppock_curve":
            continue
        own = [params[p] for p in chain if p in params]
        if len(own) == len(chain) and any(a >= b for a, b in itertools.pairwise(own)):
            return False
    return True


def values(low: float, high: float, n: int, *, whole: bool) -> list[float]:
    """n even steps; whole numbers are rounded half to even and deduplicated."""
    steps = [low + (high - low) * k / (n - 1) if n > 1 else (low + high) / 2 for k in range(n)]
    return sorted({round(v) for v in steps}) if whole else steps


def grid(name: str, n: int = 3) -> list[Params]:
    bounds = CATALOG[name][1]
    axes = [values(low, high, n, whole=isinstance(d, int)) for d, low, high in bounds.values()]
    return [p for combo in itertools.product(*axes) if valid(name, p := dict(zip(bounds, combo, strict=True)))]


def refine(name: str, best: Params, n: int = 3, share: float = 0.25) -> list[Params]:
    """A grid of a quarter around the best, within the catalog's bounds."""
    axes = []
    for p, (default, low, high) in CATALOG[name][1].items():
        reach = share * abs(best[p])
        axes.append(values(max(low, best[p] - reach), min(high, best[p] + reach), n, whole=isinstance(default, int)))
    return [p for combo in itertools.product(*axes) if valid(name, p := dict(zip(CATALOG[name][1], combo, strict=True)))]


def canonical(params: Params) -> str:
    return json.dumps(params, sort_keys=True)


def parameter_hash(params: Params) -> str:
    return hashlib.sha256(canonical(params).encode()).hexdigest()


def space_filling(candidates: list[Params], n: int) -> list[Params]:
    """The candidate nearest the centre, then always the one farthest from all chosen."""
    pool = sorted({canonical(c): c for c in candidates}.items())
    if len(pool) <= n:
        return [c for _, c in pool]
    keys = sorted(pool[0][1])
    low = {k: min(c[k] for _, c in pool) for k in keys}
    high = {k: max(c[k] for _, c in pool) for k in keys}
    at = [[(c[k] - low[k]) / (high[k] - low[k]) if high[k] > low[k] else 0.5 for k in keys] for _, c in pool]
    first = min(range(len(pool)), key=lambda i: (math.dist(at[i], [0.5] * len(keys)), pool[i][0]))
    chosen, near = [first], [math.dist(a, at[first]) for a in at]
    while len(chosen) < n:
        best = min((i for i in range(len(pool)) if i not in chosen), key=lambda i: (-near[i], pool[i][0]))
        chosen.append(best)
        near = [min(d, math.dist(a, at[best])) for d, a in zip(near, at, strict=True)]
    return [pool[i][1] for i in chosen]


def allocate(sizes: dict[str, int], budget: int, least: int = 2) -> dict[str, int]:
    """At least two candidates for each family, then one at a time to the smallest quota, by name."""
    quota = {name: min(least, n) for name, n in sizes.items()}
    if sum(quota.values()) > budget:
        raise ValueError("the budget is too small for the families")
    while sum(quota.values()) < budget:
        room = [name for name in quota if quota[name] < sizes[name]]
        if not room:
            break
        quota[min(room, key=lambda name: (quota[name], name))] += 1
    return quota


def candidates(names: list[str], budget: int, per_parameter: int = 3, make: Callable[..., list[Params]] = grid) -> dict[str, list[Params]]:
    grids = {name: make(name, per_parameter) for name in names}
    return {name: space_filling(grids[name], n) for name, n in allocate({k: len(v) for k, v in grids.items()}, budget).items()}
