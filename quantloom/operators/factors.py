"""Cross-sectional factors over a panel of brands, weights, portfolio and rank IC.

The panel is long: (symbol, ts, close). Factors partition by symbol; ranks and z-scores by
date, which is the one further exchange a query needs.
"""

from __future__ import annotations


from quantloom.functions.windows import prev, roll
from quantloom.plans.engine import Base, Query, Stage
from quantloom.sources.bars import BARS, ohlcv, table

#: A symbol of the panel has two years of bars at least.
MIN_BARS = 504
COST = 0.001

#: A cross-section that trades nearly every day: the line numbers.
_SYMBOL = "concat('L', cast(l_linenumber as string))"
_SYMBOL_SQL = "concat('L', CAST(l_linenumber AS VARCHAR))"
_PRICE = "100 + l_extendedprice / 100000.0"


def _panel_sql() -> str:
    return BARS.sql.replace("l_returnflag || l_linestatus", _SYMBOL_SQL)


ALL_BARS = Base(lambda spark, sf_dir: ohlcv(table(spark, sf_dir, "lineitem"), _SYMBOL, _PRICE), _panel_sql())
_LONG = Query(ALL_BARS, [], f"SELECT symbol, ts, close, volume FROM (SELECT *, count(close) OVER (PARTITION BY symbol) AS n FROM {{t}}) WHERE n >= {MIN_BARS}").as_base()
#: Symbols with enough bars, on the dates on which all of them have one.
PANEL = Query(
    _LONG, [], "SELECT symbol, ts, close, volume FROM (SELECT *, count(close) OVER (PARTITION BY ts) AS present FROM {t}) WHERE present = (SELECT count(DISTINCT symbol) FROM {t})"
).as_base()

DATE = "PARTITION BY ts"


def cs_rank(x: str) -> str:
    """Percentile rank with average ties among the date's valid values."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY ts, {x}) - 1) / 2.0) "
        f"/ count({x}) OVER ({DATE}) END"
    )


def cs_zscore(x: str) -> str:
    return f"({x} - avg({x}) OVER ({DATE})) / nullif(stddev_samp({x}) OVER ({DATE}), 0)"


_RETURN = {"r": f"close / {prev('close')} - 1"}


def momentum(lookback: int = 126, skip: int = 21) -> list[Stage]:
    return [{"score": f"{prev('close', skip)} / {prev('close', skip + lookback)} - 1"}]


def reversal(n: int = 5) -> list[Stage]:
    return [{"score": f"-(close / {prev('close', n)} - 1)"}]


def low_volatility(n: int = 63) -> list[Stage]:
    return [_RETURN, {"score": f"-({roll('stddev_samp', 'r', n)})"}]


def high_52w(n: int = 252) -> list[Stage]:
    return [{"score": f"close / ({roll('max', 'close', n)})"}]


def residual_momentum(lookback: int = 126, skip: int = 21, mean: int = 60) -> list[Stage]:
    return [_RETURN, {"res": f"r - ({roll('avg', 'r', mean)})"}, {"rolled": roll("sum", "res", lookback)}, {"score": prev("rolled", skip)}]


def risk_adjusted_momentum(n: int = 126) -> list[Stage]:
    return [_RETURN, {"score": f"({roll('avg', 'r', n)}) / nullif({roll('stddev_samp', 'r', n)}, 0)"}]


def composite() -> list[Stage]:
    parts = ["zm", "zr", "zv", "zh"]
    total = " + ".join(f"coalesce({p}, 0.0)" for p in parts)
    count = " + ".join(f"CASE WHEN {p} IS NULL THEN 0 ELSE 1 END" for p in parts)
    return [
        {**_RETURN, "fm": momentum()[0]["score"], "fr": reversal()[0]["score"], "fh": high_52w()[0]["score"]},
        {"fv": low_volatility()[1]["score"]},
        {"zm": cs_zscore("fm"), "zr": cs_zscore("fr"), "zv": cs_zscore("fv"), "zh": cs_zscore("fh")},
        {"score": f"({total}) / nullif({count}, 0)"},
    ]


def alpha34(short: int = 2, long: int = 5) -> list[Stage]:
    return [
        {**_RETURN, "dc": f"close - {prev('close')}"},
        {"ratio": f"round(({roll('stddev_samp', 'r', short)}) / nullif({roll('stddev_samp', 'r', long)}, 0), 9)"},
        {"a": cs_rank("ratio"), "b": cs_rank("dc")},
        {"score": "(1 - a) + (1 - b)"},
    ]


def alpha19(lag: int = 7, total: int = 250) -> list[Stage]:
    return [
        {**_RETURN, "dc": f"close - {prev('close', lag)}"},
        {"year": f"round(1 + ({roll('sum', 'r', total)}), 9)"},
        {"a": cs_rank("year")},
        {"score": "-sign(dc) * (1 + a)"},
    ]


FACTORS = {
    "xs_momentum": momentum(), "xs_reversal": reversal(), "xs_low_volatility": low_volatility(), "xs_short_term_reversal_1m": reversal(21),
    "xs_52w_high": high_52w(), "xs_residual_momentum": residual_momentum(), "xs_risk_adjusted_momentum": risk_adjusted_momentum(),
    "xs_composite": composite(), "xs_alpha34": alpha34(), "xs_alpha19": alpha19(),
}


def weights(quantile: float = 0.2) -> list[Stage]:
    """Top k at 1/k each, bottom k at -1/k; ties by symbol; fewer than two names stay flat."""
    return [
        {"n": f"count(score) OVER ({DATE})"},
        {"k": f"greatest(1, CAST(floor({quantile} * n) AS INT))", "place": "row_number() OVER (PARTITION BY ts, score IS NULL ORDER BY round(score, 12), symbol)"},
        {"w": "CASE WHEN score IS NULL OR n < 2 THEN 0.0 WHEN place > n - k THEN 1.0 / k WHEN place <= k THEN -1.0 / k ELSE 0.0 END"},
    ]


_PORTFOLIO: list[Stage] = [
    *momentum(), *weights(),
    {"r": f"coalesce(close / {prev('close')} - 1, 0.0)", "pw": f"coalesce({prev('w')}, 0.0)"},
]
_IC = f"""SELECT ts, count(*) AS n, corr(a, b) AS ic FROM (SELECT ts, {cs_rank('score')} AS a, {cs_rank('ahead')} AS b FROM {{t}} WHERE score IS NOT NULL AND ahead IS NOT NULL)
    GROUP BY ts HAVING count(*) >= 2 AND stddev_samp(a) > 1e-9 AND stddev_samp(b) > 1e-9"""
_AHEAD: list[Stage] = [*reversal(), {"ahead": "lead(close, 1) OVER (PARTITION BY symbol ORDER BY ts) / close - 1"}]


def _static(name: str, value: str) -> Base:
    return Base(
        lambda spark, sf_dir: spark.sql(f"SELECT l_linenumber AS line, {value} AS {name} FROM {{l}} GROUP BY l_linenumber", l=table(spark, sf_dir, "lineitem")),
        f"(SELECT l_linenumber AS line, {value} AS {name} FROM lineitem GROUP BY l_linenumber)",
    )


_VALUE, _QUALITY = _static("value", "avg(l_discount)"), _static("quality", "avg(l_tax)")
_LINE = "CAST(substr(symbol, 2) AS INT)"


def declared() -> dict[str, Query]:
    out = {name: Query(PANEL, stages, "SELECT symbol, ts, round(score, 6) AS score FROM {t}") for name, stages in FACTORS.items()}
    out |= {
        "xs_value": Query(PANEL, [], f"SELECT symbol, ts, round(v.value, 8) AS score FROM {{t}} LEFT JOIN {{v}} v ON v.line = {_LINE}", {"v": _VALUE}),
        "xs_quality": Query(PANEL, [], f"SELECT symbol, ts, round(q.quality, 8) AS score FROM {{t}} LEFT JOIN {{q}} q ON q.line = {_LINE}", {"q": _QUALITY}),
        "xs_quality_value": Query(
            PANEL, [], f"SELECT symbol, ts, round(q.quality * v.value, 8) AS score FROM {{t}} JOIN {{q}} q ON q.line = {_LINE} JOIN {{v}} v ON v.line = q.line",
            {"q": _QUALITY, "v": _VALUE},
        ),
        "xs_weights": Query(PANEL, [*momentum(), *weights()], "SELECT symbol, ts, round(w, 6) AS weight FROM {t} WHERE w <> 0"),
        "xs_portfolio": Query(
            PANEL, _PORTFOLIO, f"SELECT ts, round(sum(pw * r) - sum(abs(w - pw)) * {COST}, 6) AS net, round(avg(r), 6) AS benchmark, count(*) AS n FROM {{t}} GROUP BY ts",
        ),
        "rank_ic": Query(PANEL, _AHEAD, f"SELECT ts, n, round(ic, 6) AS ic FROM ({_IC})"),
        "ic_summary": Query(
            PANEL, _AHEAD,
            f"""SELECT count(*) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(avg(ic) / greatest(stddev_samp(ic), 1e-12), 6) AS ir,
                round(avg(ic) / greatest(stddev_samp(ic), 1e-12) * sqrt(count(*)), 6) AS t_stat, round(avg(CASE WHEN ic > 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM ({_IC}) HAVING count(*) >= 2""",
        ),
        "xs_panel": Query(PANEL, [], "SELECT ts, count(*) AS n_symbols, round(avg(close), 13) AS mean_close FROM {t} GROUP BY ts"),
    }
    return out
