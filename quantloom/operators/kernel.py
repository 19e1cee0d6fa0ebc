"""Backtest kernel, return aggregates, benchmark comparison and curves."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantloom.functions.windows import clip, compounded, prev, roll
from quantloom.operators.signals import SIGNALS
from quantloom.plans.engine import UPTO, Base, Query, RunningProduct, Stage, tally
from quantloom.sources.bars import BARS, table

COST = 0.001
CAPITAL = 100_000.0
YEAR = 252


def backtest(cost: float = COST) -> list[Stage]:
    """From close and signal: the position earns the next bar's return, a change of it costs."""
    return [
        {"ret": f"coalesce(close / {prev('close')} - 1, 0.0)", "pos": f"CASE WHEN signal IS NULL THEN 0.0 ELSE {clip('signal', -1.0, 1.0)} END"},
        {"turn": f"coalesce(abs(pos - {prev('pos')}), abs(pos))", "gross": f"coalesce({prev('pos')}, 0.0) * ret"},
        {"net": f"gross - turn * {cost}"},
        {"growth": "1 + net"},
        {"wealth": RunningProduct("growth")},
        {"equity": f"wealth * {CAPITAL}"},
        {"peak": f"max(equity) OVER ({UPTO})"},
    ]


def run(signal: str = "sma", base: Base = BARS, cost: float = COST, /, **params: float) -> Base:
    """The kernel's rows for one signal."""
    return Query(base, [*SIGNALS[signal](**params), *backtest(cost)], "SELECT symbol, ts, close, ret, pos, turn, gross, net, equity, peak FROM {t}").as_base()


HELD = Query(BARS, [{"signal": "1.0"}, *backtest(0.0)], "SELECT symbol, ts, close, ret, pos, turn, gross, net, equity, peak FROM {t}").as_base()

#: The benchmark: all symbols held at equal weight.
MARKET = Query(HELD, [], "SELECT ts, avg(net) AS net FROM {t} GROUP BY ts").as_base()

#: Annualised Sharpe ratio of a return column; zero when it cannot be measured.
SHARPE = f"coalesce({math.sqrt(YEAR)!r} * avg(net) / nullif(stddev_samp(net), 0), 0.0)"
METRICS = f"""count(*) AS n_bars, round({SHARPE}, 6) AS sharpe, round(avg(net) * {YEAR}, 6) AS ann_return,
    round(coalesce(stddev_samp(net), 0.0) * {math.sqrt(YEAR)!r}, 6) AS ann_vol, round(greatest(min(equity / peak - 1), -1.0), 6) AS max_drawdown,
    round(max_by(equity, ts) / min_by(equity, ts) - 1, 6) AS total_return, {tally('turn > 0')} AS n_trades"""


def moments(x: str, relation: str, key: str) -> str:
    """Bias-corrected skewness and raw kurtosis (3 for a normal); null under four rows or without spread."""
    return f"""SELECT {key}, n, round(CASE WHEN n >= 4 AND m2 > 0 THEN sqrt(n * (n - 1)) / (n - 2) * m3 / pow(m2, 1.5) END, 6) AS skew,
        round(CASE WHEN n >= 4 AND m2 > 0 THEN (n - 1) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6) + 3 END, 6) AS kurtosis
        FROM (SELECT {key}, count(*) AS n, avg(pow(d, 2)) AS m2, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4
            FROM (SELECT {key}, {x} - avg({x}) OVER (PARTITION BY {key}) AS d FROM {relation}) GROUP BY {key})"""


#: A market of its own beside the symbols: the mean order of a day.
MARKET_PRICES = Base(
    lambda spark, sf_dir: table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("ts")).agg(F.avg("o_totalprice").alias("close")).select(F.lit("market").alias("symbol"), "ts", "close"),
    "(SELECT 'market' AS symbol, CAST(o_orderdate AS DATE) AS ts, avg(o_totalprice) AS close FROM orders GROUP BY 2)",
)


def by_regime(book: Base, market: Base, window: int = 20) -> Query:
    """Per symbol and regime of ``market(symbol, ts, close)``: bars, compounded return, ratio. A bear's trailing return is negative; all else, the first bars too, is bull.

    Only times that both have count; the market's window runs over those.
    """
    aligned = Query(book, [], "SELECT b.symbol, b.ts, b.net, m.close FROM {t} b JOIN {m} m ON b.ts = m.ts", {"m": market}).as_base()
    return Query(
        aligned, [{"past": f"close / {prev('close', window)} - 1"}],
        f"""SELECT symbol, CASE WHEN past < 0 THEN 'bear' ELSE 'bull' END AS regime, count(*) AS n, round({compounded('net')}, 6) AS total, round({SHARPE}, 6) AS sharpe
            FROM {{t}} GROUP BY symbol, CASE WHEN past < 0 THEN 'bear' ELSE 'bull' END""",
    )


def against(book: Base, benchmark: Base) -> Query:
    """Per symbol against ``benchmark(ts, net)``, over the times that both have: alpha, beta, tracking error, information ratio, and the
    drawdown of the symbol's wealth in units of the benchmark's. What has no spread counts as 0."""
    aligned = Query(book, [], "SELECT b.symbol, b.ts, b.net, m.net AS other FROM {t} b JOIN {m} m ON b.ts = m.ts", {"m": benchmark}).as_base()
    stages: list[Stage] = [{"g": "1 + net", "h": "1 + other"}, {"own": RunningProduct("g"), "its": RunningProduct("h")}, {"rel": "own / its"}, {"top": f"max(rel) OVER ({UPTO})"}]
    return Query(
        aligned, stages,
        f"""SELECT symbol, n, round(beta, 6) AS beta, round((m - beta * mb) * {YEAR}, 6) AS alpha, round(te * {math.sqrt(YEAR)!r}, 6) AS tracking_error,
            round(CASE WHEN te > 0 THEN (m - mb) / nullif(te, 0) * {math.sqrt(YEAR)!r} ELSE 0.0 END, 6) AS information_ratio, round(worst, 6) AS relative_drawdown FROM
            (SELECT symbol, count(*) AS n, coalesce(covar_samp(net, other) / nullif(var_samp(other), 0), 0.0) AS beta, avg(net) AS m, avg(other) AS mb, coalesce(stddev_samp(net - other), 0.0) AS te,
                greatest(min(rel / top - 1), -1.0) AS worst FROM {{t}} GROUP BY symbol)""",
    )


def shape(x: str, relation: str, key: str) -> str:
    """Skewness and excess kurtosis as a distribution's picture shows them: mean powers over powers of the sample deviation; 0 without spread."""
    return f"""SELECT {key}, n, round(CASE WHEN sd > 0 THEN m3 / nullif(pow(sd, 3), 0) ELSE 0.0 END, 6) AS skew, round(CASE WHEN sd > 0 THEN m4 / nullif(pow(sd, 4), 0) - 3 ELSE 0.0 END, 6) AS kurtosis FROM
        (SELECT {key}, count(*) AS n, coalesce(stddev_samp(d), 0.0) AS sd, avg(pow(d, 3)) AS m3, avg(pow(d, 4)) AS m4 FROM (SELECT {key}, {x} - avg({x}) OVER (PARTITION BY {key}) AS d FROM {relation}) GROUP BY {key})"""


def declared() -> dict[str, Query]:
    sma = run("sma")
    bins = 30
    market = Query(MARKET_PRICES, [{"net": f"coalesce(close / {prev('close')} - 1, 0.0)"}], "SELECT ts, net FROM {t}").as_base()
    return {
        "market_regimes": by_regime(sma, MARKET_PRICES),
        "market_compare": against(sma, market),
        "return_shape": Query(sma, [], shape("net", "{t}", "symbol")),
        "backtest_sma": Query(sma, [], f"SELECT symbol, {METRICS} FROM {{t}} GROUP BY symbol"),
        "backtest_metrics": Query(run("momentum"), [], f"SELECT symbol, {METRICS} FROM {{t}} GROUP BY symbol"),
        "buy_and_hold": Query(HELD, [], f"SELECT symbol, {METRICS} FROM {{t}} GROUP BY symbol"),
        "equity_curve": Query(sma, [], "SELECT symbol, ts, round(equity, 4) AS equity FROM {t}"),
        "drawdown_curve": Query(sma, [], "SELECT symbol, ts, round(equity / peak - 1, 6) AS drawdown FROM {t}"),
        "rolling_sharpe": Query(
            sma,
            [{"m": roll("avg", "net", 60), "sd": roll("stddev_samp", "net", 60)}],
            f"SELECT symbol, ts, round(CASE WHEN sd > 1e-12 THEN {math.sqrt(YEAR)!r} * m / sd ELSE 0.0 END, 5) AS rolling_sharpe FROM {{t}}",
        ),
        "trade_markers": Query(
            sma, [{"dp": f"pos - {prev('pos')}"}],
            "SELECT symbol, ts, CASE WHEN dp > 0 THEN 'buy' ELSE 'sell' END AS side, round(close, 6) AS price, round(dp, 6) AS change FROM {t} WHERE dp <> 0",
        ),
        "return_moments": Query(sma, [], moments("net", "{t}", "symbol")),
        "return_distribution": Query(
            sma, [],
            f"""SELECT g.symbol, g.bin, round(g.low + (g.bin + 0.5) * g.width, 6) AS center, count(r.net) AS n FROM
                (SELECT symbol, low, width, CAST(bin AS BIGINT) AS bin FROM (SELECT symbol, CASE WHEN max(net) > min(net) THEN min(net) ELSE min(net) - 0.5 END AS low,
                    CASE WHEN max(net) > min(net) THEN (max(net) - min(net)) / {bins} ELSE 1.0 / {bins} END AS width FROM {{t}} GROUP BY symbol) CROSS JOIN {{grid}}) g
                LEFT JOIN {{t}} r ON r.symbol = g.symbol AND least(CAST(floor((r.net - g.low) / g.width) AS BIGINT), {bins - 1}) = g.bin
                GROUP BY g.symbol, g.bin, g.low, g.width""",
            {"grid": Base(lambda spark, _: spark.range(bins).toDF("bin"), f"(SELECT unnest(range({bins})) AS bin)")},
        ),
        "benchmark_compare": Query(
            sma, [],
            f"""SELECT symbol, n, round(beta, 6) AS beta, round((m - beta * mb) * {YEAR}, 6) AS alpha, round(te * {math.sqrt(YEAR)!r}, 6) AS tracking_error,
                round((m - mb) / nullif(te, 0) * {math.sqrt(YEAR)!r}, 6) AS information_ratio FROM
                (SELECT a.symbol, count(*) AS n, coalesce(covar_samp(a.net, b.net) / nullif(var_samp(b.net), 0), 0.0) AS beta, avg(a.net) AS m, avg(b.net) AS mb, stddev_samp(a.net - b.net) AS te
                FROM {{t}} a JOIN {{market}} b ON a.ts = b.ts GROUP BY a.symbol)""",
            {"market": MARKET},
        ),
        "regime_breakdown": Query(
            sma, [{"past": f"close / {prev('close', 20)} - 1"}],
            f"""SELECT symbol, CASE WHEN past < 0 THEN 'bear' ELSE 'bull' END AS regime, count(*) AS n, round({SHARPE}, 6) AS sharpe,
                round({compounded('net')}, 6) AS compounded FROM {{t}} GROUP BY symbol, CASE WHEN past < 0 THEN 'bear' ELSE 'bull' END""",
        ),
        "latest_signal": Query(sma, [], "SELECT symbol, max(ts) AS ts, max_by(pos, ts) AS position, round(max_by(close, ts), 6) AS close FROM {t} GROUP BY symbol"),
        "track_record_years": Query(BARS, [], "SELECT symbol, round(@days(max(ts); min(ts))@ / 365.25, 6) AS years FROM {t} GROUP BY symbol"),
    }
