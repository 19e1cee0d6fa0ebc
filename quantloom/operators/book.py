"""The forward book, pool analytics and calibration records: exits, promotions, agreement, separation."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators import validation
from quantloom.operators.factors import PANEL
from quantloom.operators.kernel import HELD, MARKET, YEAR, moments, run
from quantloom.operators.lab import FINAL, FROZEN, TRIALS
from quantloom.operators.statistics import SQUARED, expected_max_sharpe
from quantloom.operators.validation import GRID, RETURNS
from quantloom.plans.engine import Base, Query, tally
from quantloom.sources.bars import BARS, from_table

#: Exit rules: bars of grace, trailing window, least trailing Sharpe ratio, deepest drawdown.
GRACE, WINDOW, MIN_SHARPE, MAX_DRAWDOWN = 21, 63, 0.0, 0.25
#: A probability is judged against this reference; its normal quantile needs no distribution in SQL.
REFERENCE = 0.95
_QUANTILE = NormalDist().inv_cdf(REFERENCE)
_TOP = f"{math.sqrt(YEAR)!r}"


def _recent(x: str) -> str:
    inside = f"CASE WHEN back <= {WINDOW} THEN {x} END"
    return f"coalesce({_TOP} * avg({inside}) / nullif(stddev_samp({inside}), 0), 0.0)"


def lifecycle(book: Base, held: Base, frozen: str = FROZEN) -> Query:
    """Hold or exit by the rows after the freeze: (symbol, n, sharpe, held_sharpe, drawdown, state, reasons).

    Both curves are computed over the whole history and cut afterwards, so no indicator restarts.
    """
    w = "PARTITION BY f.symbol ORDER BY f.ts"
    rows = f"""SELECT f.symbol, f.net, h.net AS held, row_number() OVER ({w} DESC) AS back,
        f.equity / max(f.equity) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS down
        FROM {{t}} f JOIN {{held}} h ON f.symbol = h.symbol AND f.ts = h.ts WHERE f.ts > {frozen}"""
    scored = f"SELECT symbol, count(*) AS n, {_recent('net')} AS sharpe, {_recent('held')} AS held_sharpe, least(-min(down), 1.0) AS drawdown FROM ({rows}) GROUP BY symbol"
    reasons = f"""CASE WHEN n < {GRACE} THEN 'grace' ELSE concat_ws(',', CASE WHEN sharpe <= {MIN_SHARPE} THEN 'decayed' END,
        CASE WHEN drawdown > {MAX_DRAWDOWN} THEN 'drawdown' END, CASE WHEN sharpe <= held_sharpe THEN 'behind holding' END) END"""
    return Query(
        book, [],
        f"""SELECT symbol, n, round(sharpe, 6) AS sharpe, round(held_sharpe, 6) AS held_sharpe, round(drawdown, 6) AS drawdown,
            CASE WHEN n < {GRACE} OR reasons = '' THEN 'hold' ELSE 'exit' END AS state, reasons FROM (SELECT *, {reasons} AS reasons FROM ({scored}))""",
        {"held": held},
    )


def managed(book: Base, graduates: Base, states: Base) -> Query:
    """One step of ``book(symbol, config, status)``.

    Graduates that it never held (open or closed) are promoted; open positions exit by their
    state, and stay as they are where no state could be computed; closed ones stay closed.
    """
    return Query(
        book, [],
        """SELECT p.symbol, CAST(p.config AS BIGINT) AS config, CASE WHEN p.status = 'open' AND s.state = 'exit' THEN 'closed' ELSE p.status END AS status, promoted,
            CASE WHEN p.status = 'open' AND s.state = 'exit' THEN s.reasons END AS exit_reasons FROM
            (SELECT symbol, config, status, false AS promoted FROM {t} UNION ALL SELECT g.symbol, g.config, 'open', true
                FROM (SELECT DISTINCT symbol, config FROM {graduates}) g LEFT JOIN (SELECT DISTINCT symbol, config, true AS known FROM {t}) b ON g.symbol = b.symbol AND g.config = b.config WHERE b.known IS NULL) p
            LEFT JOIN {states} s ON p.symbol = s.symbol""",
        {"graduates": graduates, "states": states},
    )


def separation(trials: Base, category: str) -> Query:
    """Best trial of each category in each experiment: medians, share of winners, median lead of the best."""
    best = f"SELECT symbol, {category} AS category, max(sharpe) AS best, max(n) AS n FROM {{t}} GROUP BY symbol, {category}"
    placed = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(best, 12) DESC, category) AS place FROM ({best})"
    gap = f"SELECT @pct(gap; 0.5)@ AS gap FROM (SELECT symbol, max(CASE WHEN place = 1 THEN best END) - max(CASE WHEN place = 2 THEN best END) AS gap FROM ({placed}) GROUP BY symbol)"
    return Query(
        trials, [],
        f"""SELECT c.category, c.n, round(c.median, 6) AS median, round(c.won / CAST(e.n AS DOUBLE), 6) AS winner_share, round(g.gap, 6) AS median_gap,
            g.gap > sqrt((1 + g.gap * g.gap / {SQUARED}) / (e.bars / {YEAR}.0)) AS separable FROM
            (SELECT category, count(*) AS n, @pct(best; 0.5)@ AS median, sum(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END) AS won FROM ({placed}) GROUP BY category) c
            CROSS JOIN (SELECT count(DISTINCT symbol) AS n, @pct(n; 0.5)@ AS bars FROM ({best})) e CROSS JOIN ({gap}) g""",
    )


def agreement() -> Query:
    """Finalists by two verdicts: margin over the pool's bar, and probability above the reference."""
    haircut = expected_max_sharpe(1.0, len(GRID))
    spread = "greatest((@pct(sharpe; 0.75)@ - @pct(sharpe; 0.25)@) / 1.34898, 1e-6)"
    per_bar = f"(f.sharpe - d.spread * {haircut!r}) / {_TOP}"
    observed = f"f.sharpe / {_TOP}"
    z = f"{per_bar} * sqrt(f.n - 1) / sqrt(nullif(greatest(1 - m.skew * {observed} + (m.kurtosis - 1) / 4.0 * {observed} * {observed}, 0.0), 0))"
    judged = f"""SELECT f.margin > sqrt(1 / f.years) * sqrt(2 * ln(d2.n)) AS margin_ok, {z} > {_QUANTILE!r} AS probable FROM {{t}} f
        JOIN (SELECT symbol, {spread} AS spread FROM {{trials}} GROUP BY symbol) d ON f.symbol = d.symbol
        JOIN {{moments}} m ON f.symbol = m.symbol AND f.config = m.config CROSS JOIN (SELECT count(DISTINCT symbol) AS n FROM {{t}}) d2"""
    return Query(
        FINAL, [],
        f"""SELECT count(*) AS n, {tally('margin_ok AND probable')} AS both_pass, {tally('NOT margin_ok AND NOT probable')} AS both_fail,
            {tally('margin_ok AND NOT probable')} AS margin_only, {tally('NOT margin_ok AND probable')} AS probability_only FROM ({judged}) WHERE probable IS NOT NULL""",
        {"trials": TRIALS, "moments": Query(RETURNS, [], moments("net", "{t}", "symbol, config")).as_base()},
    )


def against_null(real: Base, null: Base) -> Query:
    """``real(statistic, value, bars)`` against each mode of ``null(mode, statistic, value, bars)``."""
    return Query(
        real, [],
        """SELECT r.statistic, z.mode, r.n AS real_n, round(r.median, 6) AS real_median, z.n AS null_n, round(z.median, 6) AS null_median, round(z.p95, 6) AS null_p95,
            r.median > z.p95 AS exceeds, r.bars = z.bars AS comparable FROM
            (SELECT statistic, count(*) AS n, @pct(value; 0.5)@ AS median, @pct(bars; 0.5)@ AS bars FROM {t} WHERE value IS NOT NULL GROUP BY statistic) r
            JOIN (SELECT mode, statistic, count(*) AS n, @pct(value; 0.5)@ AS median, @pct(value; 0.95)@ AS p95, @pct(bars; 0.5)@ AS bars FROM {null} WHERE value IS NOT NULL GROUP BY mode, statistic) z
            ON r.statistic = z.statistic""",
        {"null": null},
    )


def merged_calibration(shards: Base) -> Query:
    """``shards(shard, version, mode, symbol, sharpe, years)`` as one record, judged anew at its whole size.

    Shards of different versions or modes are refused: the record has no verdict then.
    """
    bar = "sqrt(1 / years) * sqrt(2 * ln(n))"
    return Query(
        shards, [],
        f"""SELECT n, n_shards, mergeable, round(years, 6) AS years, CASE WHEN mergeable THEN n_clear END AS n_clear, round(CASE WHEN mergeable THEN n_clear / CAST(n AS DOUBLE) END, 6) AS rate, round(top, 6) AS top FROM
            (SELECT max(c.n) AS n, max(c.n_shards) AS n_shards, max(c.years) AS years, max(c.kinds) = 1 AS mergeable, {tally(f'sharpe > {bar.replace("years", "c.years").replace("(n)", "(c.n)")}')} AS n_clear, max(sharpe) AS top FROM {{t}}
            CROSS JOIN (SELECT count(*) AS n, count(DISTINCT shard) AS n_shards, count(DISTINCT concat(version, '/', mode)) AS kinds, @pct(years; 0.5)@ AS years FROM {{t}}) c)""",
    )


def require_mergeable(merged: DataFrame) -> DataFrame:
    """``merged`` of ``merged_calibration``, or an error where its shards have different versions or modes."""
    refused = F.raise_error(F.lit("shards of different versions or modes cannot be merged")).cast("long")
    return merged.withColumn("n", F.when(F.col("mergeable"), F.col("n")).otherwise(refused))


def interpreted(pbo: Base, deflated: Base, stability: Base) -> Query:
    """A verdict for each headline metric of a symbol."""
    def rule(metric: str, key: str, good: str, warning: str) -> str:
        return f"SELECT symbol, '{metric}' AS metric, CASE WHEN {good} THEN 'good' WHEN {warning} THEN 'warning' ELSE 'bad' END AS verdict FROM {{{key}}}"

    parts = [rule("pbo", "t", "pbo < 0.3", "pbo < 0.5"), rule("margin", "d", "margin > 0", "false"), rule("stability", "s", "stability > 0.7", "stability > 0.4")]
    return Query(pbo, [], " UNION ALL ".join(parts), {"d": deflated, "s": stability})


def panel_holdout(panel: Base, fraction: float = 0.2, least: int = 252) -> Base:
    """The panel with ``part``: its last dates, numbered once per date and joined back."""
    return Query(
        panel, [],
        f"""SELECT p.*, CASE WHEN d.k > d.n - greatest(CAST(floor({fraction} * d.n) AS BIGINT), {least}) THEN 'holdout' ELSE 'head' END AS part FROM {{t}} p JOIN
            (SELECT ts, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM {{t}})) d ON p.ts = d.ts""",
    ).as_base()


def declared() -> dict[str, Query]:
    validated = validation.declared()
    states = lifecycle(run("sma"), HELD)
    oos = lambda name, stat: Query(validated[name].as_base(), [], f"SELECT '{stat}' AS statistic, symbol, oos_sharpe AS value, 1.0 AS bars FROM {{t}}").as_base()
    null = Query(from_table("events"), [], "SELECT event_type AS mode, 'walk-forward' AS statistic, value / 100 AS value, 1.0 AS bars FROM {t}").as_base()
    shards = Query(from_table("events"), [], "SELECT event_type AS shard, 'v1' AS version, 'iid' AS mode, user_id AS symbol, value / 50 AS sharpe, 4.3 AS years FROM {t}").as_base()
    book = Query(TRIALS, [], "SELECT symbol, config, CASE WHEN sharpe > 0 THEN 'open' ELSE 'closed' END AS status FROM {t}").as_base()
    searched = Query(from_table("lineitem"), [], "SELECT l_orderkey AS symbol, l_returnflag AS category, l_tax * 50 - l_discount * 20 AS sharpe, 5400 AS n FROM {t}").as_base()
    graduates = Query(FINAL, [], "SELECT symbol, config FROM {t}").as_base()
    upto = "PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    # a portfolio that has lost everything stays at nothing
    running = lambda x: f"CASE WHEN min(1 + {x}) OVER ({upto}) <= 0 THEN 0.0 ELSE exp(sum(ln(greatest(1 + {x}, 1e-300))) OVER ({upto})) END"
    begun = "first_value({x}) OVER (PARTITION BY symbol ORDER BY ts)"
    return {
        "lifecycle": states,
        "managed_book": managed(book, graduates, states.as_base()),
        "category_separation": separation(searched, "category"),
        "statistic_agreement": agreement(),
        "null_comparison": against_null(oos("walk_forward", "walk-forward"), null),
        "calibration_merge": merged_calibration(shards),
        "interpretation": interpreted(validated["pbo"].as_base(), validated["deflated_sharpe"].as_base(), validated["parameter_stability"].as_base()),
        "panel_holdout": Query(panel_holdout(PANEL), [], "SELECT part, count(*) AS n, count(DISTINCT symbol) AS n_symbols, CAST(min(ts) AS STRING) AS since, CAST(max(ts) AS STRING) AS until FROM {t} GROUP BY part"),
        "closed_bars": Query(BARS, [], "SELECT symbol, count(*) AS n, max(ts) AS until FROM {t} WHERE ts < CAST(date_trunc('day', TIMESTAMP '1998-06-15 13:45:00') AS DATE) GROUP BY symbol"),
        "equity_points": Query(
            run("sma"), [{"e0": begun.format(x="equity"), "c0": begun.format(x="close")}, {"gain": "equity / e0 - 1", "market": "close / c0 - 1"}],
            "SELECT symbol, ts, round(gain, 6) AS return_since_start, round(market, 6) AS benchmark_return, round(gain - market, 6) AS alpha FROM {t}",
        ),
        "relative_drawdown": Query(
            run("sma"), [],
            f"""SELECT symbol, round(greatest(min(rel / peak) - 1, -1.0), 6) AS drawdown FROM
                (SELECT symbol, rel, max(rel) OVER ({upto}) AS peak FROM (SELECT symbol, ts, own / market AS rel FROM
                (SELECT symbol, ts, {running('own')} AS own, {running('market')} AS market FROM (SELECT a.symbol, a.ts, a.net AS own, b.net AS market FROM {{t}} a JOIN {{market}} b ON a.ts = b.ts)))) GROUP BY symbol""",
            {"market": MARKET},
        ),
    }
