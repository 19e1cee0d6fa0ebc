"""Search, gate, leaderboard, forward book, pool analytics and execution diffs."""

from __future__ import annotations

import math
from dataclasses import replace

from quantloom.functions.windows import compounded
from quantloom.operators.kernel import HELD, SHARPE, run
from quantloom.operators.statistics import expected_max_sharpe
from quantloom.operators import validation
from quantloom.operators.validation import GRID, RETURNS, returns
from quantloom.plans.engine import Base, Query
from quantloom.sources.bars import BARS

YEAR = math.sqrt(252)
HOLDOUT, HOLDOUT_ROWS = 0.2, 252

_SHARPE = f"coalesce({YEAR!r} * avg(net) / nullif(stddev_samp(net), 0), 0.0)"


def trials(rows: Base) -> Base:
    """One experiment per symbol and configuration."""
    return Query(rows, [], f"SELECT symbol, config, count(*) AS n, min(ts) AS since, max(ts) AS until, {_SHARPE} AS sharpe FROM {{t}} GROUP BY symbol, config").as_base()


TRIALS = trials(RETURNS)
_TAIL = f"greatest(CAST(floor({HOLDOUT} * n) AS BIGINT), {HOLDOUT_ROWS})"


def _split(base: Base) -> Base:
    return Query(
        base, [], f"SELECT *, CASE WHEN i >= n - {_TAIL} THEN 'holdout' ELSE 'head' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {{t}})"
    ).as_base()


#: What a search may see, and the sealed rest that only its finalist is scored on.
HEAD = Query(_split(BARS), [], "SELECT symbol, ts, open, high, low, close, volume FROM {t} WHERE part = 'head'").as_base()
_HOLDOUT_BARS = Query(_split(BARS), [], "SELECT symbol, ts, open, high, low, close, volume FROM {t} WHERE part = 'holdout'").as_base()
_HELD_OUT = Query(
    _HOLDOUT_BARS, [{"r": "coalesce(close / lag(close, 1) OVER (PARTITION BY symbol ORDER BY ts) - 1, 0.0)"}], "SELECT symbol, r AS net FROM {t}"
).as_base()


def final(experiments: Base) -> Base:
    """The best configuration of each symbol."""
    return Query(experiments, [], f"""SELECT symbol, config, sharpe, n, n_trials, sharpe - greatest(sd * {expected_max_sharpe(1.0, len(GRID))!r}, 0.0) AS margin, years FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 12) DESC, config) AS place, stddev_samp(sharpe) OVER (PARTITION BY symbol) AS sd,
        count(*) OVER (PARTITION BY symbol) AS n_trials, @days(until; since)@ / 365.25 AS years FROM {{t}}) WHERE place = 1""").as_base()


FINAL = final(TRIALS)
#: Selected on the head alone.
_SEARCHED = final(trials(returns(HEAD)))
FROZEN = "DATE '1999-06-30'"


def declared() -> dict[str, Query]:
    sma, held, validated = run("sma"), HELD, validation.declared()
    forward = f"""SELECT f.symbol, count(*) AS n, round({compounded('f.net')}, 6) AS total, round({compounded('h.net')}, 6) AS held,
        round(coalesce({YEAR!r} * avg(f.net) / nullif(stddev_samp(f.net), 0), 0.0), 6) AS sharpe FROM {{t}} f JOIN {{held}} h ON f.symbol = h.symbol AND f.ts = h.ts WHERE f.ts > {FROZEN} GROUP BY f.symbol"""
    return {
        "holdout_split": Query(_split(BARS), [], "SELECT symbol, part, count(*) AS n, min(ts) AS since, max(ts) AS until FROM {t} GROUP BY symbol, part"),
        "holdout_score": Query(run("sma", _HOLDOUT_BARS), [], f"SELECT symbol, count(*) AS n, round({SHARPE}, 6) AS sharpe FROM {{t}} GROUP BY symbol"),
        "gate": Query(
            _SEARCHED, [],
            """SELECT symbol, round(margin, 6) AS margin, margin > 0 AS deflated_ok, p.pbo < 0.5 AS overfitting_ok, s.stability >= 0.4 AS stability_ok,
                years >= CASE WHEN f.sharpe > 0 THEN 2 * ln(n_trials) / (f.sharpe * f.sharpe) ELSE 1e9 END AS length_ok, h.sharpe > 0 AS holdout_ok, h.sharpe > b.sharpe AS beats_held,
                margin > 0 AND p.pbo < 0.5 AND s.stability >= 0.4 AND h.sharpe > 0 AND h.sharpe > b.sharpe
                    AND years >= CASE WHEN f.sharpe > 0 THEN 2 * ln(n_trials) / (f.sharpe * f.sharpe) ELSE 1e9 END AS graduated
                FROM {t} f JOIN {h} h USING (symbol, config) JOIN {b} b USING (symbol) JOIN {p} p USING (symbol) JOIN {s} s USING (symbol)""",
            {
                "h": trials(returns(_HOLDOUT_BARS)),
                "b": Query(_HELD_OUT, [], f"SELECT symbol, {SHARPE} AS sharpe FROM {{t}} GROUP BY symbol").as_base(),
                "p": replace(validated["pbo"], base=returns(HEAD)).as_base(),
                "s": replace(validated["parameter_stability"], base=returns(HEAD)).as_base(),
            },
        ),
        "leaderboard": Query(_SEARCHED, [], f"SELECT symbol, CAST(config AS BIGINT) AS config, round(sharpe, 6) AS sharpe, round(margin, 6) AS margin, margin > sqrt(1 / years) * sqrt(2 * ln(n_symbols)) AS survives, CAST(row_number() OVER (ORDER BY margin > 0 DESC, round(margin, 9) DESC, symbol) AS BIGINT) AS place FROM {{t}} CROSS JOIN (SELECT count(DISTINCT symbol) AS n_symbols FROM {{t}})"),
        "forward_score": Query(sma, [], forward, {"held": held}),
        "sizing": Query(sma, [], """SELECT symbol, CAST(CASE WHEN shares < 0 THEN ceil(shares) ELSE floor(shares) END AS BIGINT) AS shares FROM (SELECT symbol, 100000.0 / k * p / c AS shares
            FROM (SELECT symbol, max_by(pos, ts) AS p, max_by(close, ts) AS c FROM {t} GROUP BY symbol)
            CROSS JOIN (SELECT sum(CASE WHEN p <> 0 THEN 1 ELSE 0 END) AS k FROM (SELECT max_by(pos, ts) AS p FROM {t} GROUP BY symbol)))"""),
        "inception_return": Query(BARS, [], "SELECT symbol, round(max_by(close, ts) / min_by(close, ts) - 1, 6) AS total FROM {t} GROUP BY symbol HAVING count(*) >= 2"),
    }
