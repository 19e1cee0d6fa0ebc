"""Validation over a whole parameter grid from sufficient statistics.

All configurations of a grid are columns of one window pass, then rows (symbol, config, bar).
Overfitting, walk-forward and cross-validation only need n, sum and sum of squares per
configuration and segment, joined to a small table of splits.
"""

from __future__ import annotations

import math

from quantloom.functions.windows import prev, roll, side
from quantloom.operators.kernel import COST
from quantloom.operators.statistics import expected_max_sharpe
from quantloom.plans.engine import Base, Query, Stage, tally
from quantloom.sources.bars import BARS

GRID = [(f, s) for f in (10, 20, 30) for s in (50, 100, 200)]
YEAR = math.sqrt(252)
GROUPS, FOLDS = 10, 5
#: The longest lookback of the grid, two bars at least.
EMBARGO = max(2, *(w for g in GRID for w in g))


def grid_stages() -> list[Stage]:
    n = range(len(GRID))
    return [
        {"r": f"coalesce(close / {prev('close')} - 1, 0.0)", **{f"a{w}": roll("avg", "close", w) for w in sorted({w for g in GRID for w in g})}},
        {f"p{k}": side(f"a{GRID[k][0]} > a{GRID[k][1]}", f"a{GRID[k][0]} < a{GRID[k][1]}") for k in n},
        {f"net{k}": f"coalesce({prev(f'p{k}')}, 0.0) * r - coalesce(abs(p{k} - {prev(f'p{k}')}), abs(p{k})) * {COST}" for k in n},
        {"i": "row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1", "n": "count(*) OVER (PARTITION BY symbol)"},
    ]


def returns(bars: Base) -> Base:
    """Rows (symbol, config, bar) of every configuration of the grid, run on these bars alone."""
    return Query(bars, grid_stages(), f"SELECT symbol, ts, r, CAST(i AS BIGINT) AS i, n, @long(net; {len(GRID)})@ FROM {{t}}").as_base()


RETURNS = returns(BARS)


def ratio(n: str, s: str, q: str) -> str:
    """Mean over standard deviation (ddof 1) from sums; zero without spread."""
    var = f"greatest(({q} - {s} * {s} / {n}) / nullif({n} - 1, 0), 0.0)"
    return f"coalesce(CASE WHEN {var} > 1e-18 THEN {s} / {n} / sqrt({var}) END, 0.0)"


def sums(condition: str, name: str) -> str:
    return ", ".join(f"sum(CASE WHEN {condition} THEN {x} ELSE 0 END) AS {name}_{k}" for k, x in (("n", "c"), ("s", "s"), ("q", "q")))


def segments(segment: str) -> str:
    return f"SELECT symbol, config, {segment} AS g, count(*) AS c, sum(net) AS s, sum(net * net) AS q FROM {{t}} GROUP BY symbol, config, {segment}"


_SPLIT = f"CAST(CASE WHEN i < (n % {GROUPS}) * floor(n / {GROUPS} + 1) THEN floor(i / floor(n / {GROUPS} + 1)) ELSE (n % {GROUPS}) + floor((i - (n % {GROUPS}) * floor(n / {GROUPS} + 1)) / floor(n / {GROUPS})) END AS INT)"
_MASKS = Base(
    lambda spark, _: spark.range(1 << GROUPS).selectExpr("id AS m").where(f"bit_count(m) = {GROUPS // 2}"),
    f"(SELECT m FROM (SELECT unnest(range({1 << GROUPS})) AS m) WHERE bit_count(m) = {GROUPS // 2})",
)
_STEPS = Base(lambda spark, _: spark.range(FOLDS).selectExpr("id AS k"), f"(SELECT unnest(range({FOLDS})) AS k)")
_FOLD = f"CAST(least(floor(i / floor(n / {FOLDS + 1})), {FOLDS}) AS INT)"


def _selected(scored: str, split: str) -> str:
    """The best configuration in sample (the first of equals) of each split."""
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, {split} ORDER BY round(tr, 12) DESC, config) AS best FROM ({scored})) WHERE best = 1"


def _purged() -> str:
    """Rows fall into the fold that they belong to and the set of folds that may train on them; only those sums meet the folds."""
    start = [f"floor({k} * n / {FOLDS})" for k in range(FOLDS + 1)]
    own = "CASE " + " ".join(f"WHEN i < {start[k + 1]} THEN {k}" for k in range(FOLDS)) + " END"
    far = " + ".join(f"CASE WHEN i < {start[k]} - {EMBARGO} OR i >= {start[k + 1]} + {EMBARGO} THEN {1 << k} ELSE 0 END" for k in range(FOLDS))
    dealt = f"SELECT symbol, config, own, far, count(*) AS c, sum(net) AS s, sum(net * net) AS q FROM (SELECT symbol, config, net, {own} AS own, {far} AS far FROM {{t}}) GROUP BY symbol, config, own, far"
    agg = f"SELECT symbol, config, k, {sums('@bit(far; CAST(k AS INT))@ = 1', 'a')}, {sums('own = k', 'b')} FROM ({dealt}) CROSS JOIN {{steps}} GROUP BY symbol, config, k"
    return f"SELECT symbol, config, k, {ratio('a_n', 'a_s', 'a_q')} * {YEAR!r} AS tr, {ratio('b_n', 'b_s', 'b_q')} * {YEAR!r} AS te FROM ({agg}) WHERE a_n > 0"


def declared() -> dict[str, Query]:
    sharpe = f"coalesce({YEAR!r} * avg(net) / nullif(stddev_samp(net), 0), 0.0)"
    grid = f"SELECT symbol, config, count(*) AS n, {sharpe} AS sharpe FROM {{t}} GROUP BY symbol, config"
    pbo_agg = f"SELECT symbol, config, m, {sums('@bit(m; g)@ = 1', 'a')}, {sums('@bit(m; g)@ = 0', 'b')} FROM ({segments(_SPLIT)}) CROSS JOIN {{masks}} GROUP BY symbol, config, m"
    pbo = f"SELECT symbol, config, m, {ratio('a_n', 'a_s', 'a_q')} AS tr, {ratio('b_n', 'b_s', 'b_q')} AS te FROM ({pbo_agg})"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY symbol, m ORDER BY round(te, 12), config) AS place, row_number() OVER (PARTITION BY symbol, m ORDER BY round(tr, 12) DESC, config) AS best FROM ({pbo})"
    wf_agg = f"SELECT symbol, config, k, {sums('g <= k', 'a')}, {sums('g = k + 1', 'b')} FROM ({segments(_FOLD)}) CROSS JOIN {{steps}} GROUP BY symbol, config, k"
    wf = f"SELECT symbol, config, k, {ratio('a_n', 'a_s', 'a_q')} * {YEAR!r} AS tr, {ratio('b_n', 'b_s', 'b_q')} * {YEAR!r} AS te FROM ({wf_agg})"
    report = f"""SELECT symbol, count(*) AS n_splits, round(avg(tr), 5) AS is_sharpe, round(avg(te), 5) AS oos_sharpe, round(avg(CASE WHEN te > 0 THEN 1.0 ELSE 0.0 END), 6) AS consistency,
        round(CASE WHEN avg(tr) > 0 THEN avg(te) / avg(tr) END, 5) AS efficiency"""
    spread = "CASE WHEN count(*) < 4 THEN stddev_samp(sharpe) ELSE (@pct(sharpe; 0.75)@ - @pct(sharpe; 0.25)@) / 1.34898 END"
    haircut = expected_max_sharpe(1.0, len(GRID))
    return {
        "grid_expand": Query(BARS, [], "SELECT s.symbol, s.n, g.config, g.fast, g.slow FROM (SELECT symbol, count(*) AS n FROM {t} GROUP BY symbol) s CROSS JOIN {g} g WHERE g.fast < g.slow", {"g": Base(
            lambda spark, _: spark.createDataFrame([(k, *g) for k, g in enumerate(GRID)], "config int, fast int, slow int"),
            "(SELECT * FROM (VALUES " + ", ".join(f"({k}, {f}, {s})" for k, (f, s) in enumerate(GRID)) + ") g(config, fast, slow))")}),
        "grid_sharpes": Query(RETURNS, [], f"SELECT symbol, CAST(config AS BIGINT) AS config, n, round(sharpe, 6) AS sharpe FROM ({grid})"),
        "parameter_stability": Query(RETURNS, [], f"""SELECT symbol, round(avg(sharpe), 6) AS mean, round(stddev_samp(sharpe), 6) AS sd, round(min(sharpe), 6) AS low, round(max(sharpe), 6) AS high,
            round(avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive, round(1 / (1 + stddev_samp(sharpe) / (abs(avg(sharpe)) + 1e-9)), 6) AS stability FROM ({grid}) GROUP BY symbol"""),
        "robust_dispersion": Query(RETURNS, [], f"SELECT symbol, round(greatest({spread}, 1e-6), 6) AS dispersion FROM ({grid}) GROUP BY symbol"),
        "deflated_sharpe": Query(RETURNS, [], f"SELECT symbol, round(max(sharpe), 6) AS observed, round(max(sharpe) - greatest(stddev_samp(sharpe) * {haircut!r}, 0.0), 6) AS margin FROM ({grid}) GROUP BY symbol"),
        "pbo": Query(RETURNS, [], f"SELECT symbol, count(*) AS n_splits, round(avg(CASE WHEN place / {len(GRID) + 1.0} <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS pbo FROM ({ranked}) WHERE best = 1 GROUP BY symbol", {"masks": _MASKS}),
        "walk_forward": Query(RETURNS, [], f"{report} FROM ({_selected(wf, 'k')}) GROUP BY symbol", {"steps": _STEPS}),
        "purged_cv": Query(RETURNS, [], f"{report} FROM ({_selected(_purged(), 'k')}) GROUP BY symbol", {"steps": _STEPS}),
        "best_trial": Query(RETURNS, [], f"SELECT symbol, CAST(config AS BIGINT) AS config, round(sharpe, 6) AS sharpe FROM ({_selected(f'SELECT symbol, config, sharpe, sharpe AS tr FROM ({grid})', 'symbol')})"),
        "positive_configs": Query(RETURNS, [], f"SELECT CAST(config AS BIGINT) AS config, {tally('sharpe > 0')} AS n_positive FROM ({grid}) GROUP BY config"),
    }
