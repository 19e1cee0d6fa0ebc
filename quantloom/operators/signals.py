"""The 34 single-name signals, as staged window projections ending in ``signal``.

Every signal is causal: its stages only look at the row and those before it. Until its
windows are full it is flat. Parameters default to the catalog's.
"""

from __future__ import annotations

import math

from quantloom.functions.windows import before, clip, prev, roll, side, sign
from quantloom.plans.engine import UPTO, Ewm, Stage, stages_sql

TRUE_RANGE = f"greatest(high - low, abs(high - {prev('close')}), abs(low - {prev('close')}))"
YEAR = 252


def span(n: int) -> float:
    return 2 / (n + 1)


def carried(raw: str) -> list[Stage]:
    """The last side taken, from the first on."""
    return [{"raw": raw}, {"signal": "coalesce(@ffill(nullif(raw, 0.0))@, 0.0)"}]


def sma(fast: int = 20, slow: int = 50) -> list[Stage]:
    return [{"f": roll("avg", "close", fast), "s": roll("avg", "close", slow)}, {"signal": side("f > s", "f < s")}]


def momentum(lookback: int = 60, skip: int = 5) -> list[Stage]:
    return [{"r": f"{prev('close', skip)} / {prev('close', skip + lookback)} - 1"}, {"signal": sign("r")}]


def mean_reversion(window: int = 20, k: float = 2.0) -> list[Stage]:
    z = clip(f"-((close - m) / nullif(sd, 0) / {k})", -1.0, 1.0)
    return [
        {"m": roll("avg", "close", window), "sd": roll("stddev_samp", "close", window)},
        {"signal": f"CASE WHEN sd IS NULL THEN 0.0 WHEN sd = 0 THEN {side('close < m', 'close > m')} ELSE {z} END"},
    ]


def _gains() -> list[Stage]:
    return [{"d": f"close - {prev('close')}"}, {"gain": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "loss": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"}]


_RSI = "CASE WHEN ag IS NULL THEN NULL WHEN al = 0 AND ag = 0 THEN 50.0 WHEN al = 0 THEN 100.0 ELSE 100 - 100 / (1 + ag / nullif(al, 0)) END"


def rsi_mean_reversion(window: int = 14, oversold: float = 30, overbought: float = 70) -> list[Stage]:
    return [*_gains(), {"ag": roll("avg", "gain", window), "al": roll("avg", "loss", window)}, {"rsi": _RSI}, {"signal": side(f"rsi < {oversold}", f"rsi > {overbought}")}]


def donchian_breakout(lookback: int = 20) -> list[Stage]:
    return [{"hi": before("max", "close", lookback), "lo": before("min", "close", lookback)}, *carried(side("close > hi", "close < lo"))]


def bollinger_bands(window: int = 20, num_std: float = 2.0) -> list[Stage]:
    return [
        {"m": roll("avg", "close", window), "sd": roll("stddev_samp", "close", window)},
        {"signal": side(f"close < m - {num_std} * sd", f"close > m + {num_std} * sd")},
    ]


def macd_crossover(fast: int = 12, slow: int = 26, signal: int = 9) -> list[Stage]:
    return [
        {"ef": Ewm("close", span(fast)), "es": Ewm("close", span(slow))},
        {"macd": "ef - es"},
        {"trigger": Ewm("macd", span(signal))},
        {"signal": sign("macd - trigger")},
    ]


def keltner_channel(ma: int = 20, atr: int = 14, multiplier: float = 2.0) -> list[Stage]:
    return [
        {"tr": TRUE_RANGE, "mid": Ewm("close", span(ma))},
        {"atr": roll("avg", "tr", atr)},
        {"signal": side(f"close > mid + {multiplier} * atr", f"close < mid - {multiplier} * atr")},
    ]


_LOG_RETURN = f"ln(close / {prev('close')})"


def vol_targeted_sma(fast: int = 20, slow: int = 50, vol: int = 30, target: float = 0.15) -> list[Stage]:
    return [
        {"f": roll("avg", "close", fast), "s": roll("avg", "close", slow), "lr": _LOG_RETURN},
        {"sd": roll("stddev_samp", "lr", vol)},
        {"scale": f"CASE WHEN sd IS NULL THEN 0.0 WHEN sd = 0 THEN 1.0 ELSE least(1.0, {target} / (nullif(sd, 0) * {math.sqrt(YEAR)!r})) END"},
        {"signal": f"{side('f > s', 'f < s')} * scale"},
    ]


def trend_filtered_mean_reversion(z: int = 20, threshold: float = 1.5, trend: int = 100) -> list[Stage]:
    return [
        {"m": roll("avg", "close", z), "sd": roll("stddev_samp", "close", z), "t": roll("avg", "close", trend)},
        {"z": "(close - m) / nullif(sd, 0)"},
        {"signal": side(f"z < -{threshold} AND close > t", f"z > {threshold} AND close < t")},
    ]


def triple_ma_alignment(fast: int = 10, medium: int = 30, slow: int = 100) -> list[Stage]:
    return [
        {"f": roll("avg", "close", fast), "m": roll("avg", "close", medium), "s": roll("avg", "close", slow)},
        {"signal": side("f > m AND m > s", "f < m AND m < s")},
    ]


def williams_r(window: int = 14, oversold: float = -80, overbought: float = -20) -> list[Stage]:
    return [
        {"hh": roll("max", "high", window), "ll": roll("min", "low", window)},
        {"r": "-100 * (hh - close) / nullif(hh - ll, 0)"},
        {"signal": side(f"r < {oversold}", f"r > {overbought}")},
    ]


def cci(window: int = 20, threshold: float = 100) -> list[Stage]:
    parts = " + ".join(["abs(tp - m)"] + [f"abs({prev('tp', k)} - m)" for k in range(1, window)])
    return [
        {"tp": "(high + low + close) / 3"},
        {"m": roll("avg", "tp", window)},
        {"mad": f"({parts}) / {window}"},
        {"cci": "(tp - m) / nullif(0.015 * mad, 0)"},
        {"signal": side(f"cci < -{threshold}", f"cci > {threshold}")},
    ]


def stochastic_oscillator(k: int = 14, d: int = 3, oversold: float = 20, overbought: float = 80) -> list[Stage]:
    return [
        {"hh": roll("max", "high", k), "ll": roll("min", "low", k)},
        {"k": "100 * (close - ll) / nullif(hh - ll, 0)"},
        {"d": roll("avg", "k", d)},
        {"signal": side(f"d < {oversold}", f"d > {overbought}")},
    ]


def trix(window: int = 15, signal: int = 9) -> list[Stage]:
    a = span(window)
    return [
        {"e1": Ewm("close", a)}, {"e2": Ewm("e1", a)}, {"e3": Ewm("e2", a)},
        {"trix": f"e3 / {prev('e3')} - 1"}, {"trigger": Ewm("trix", span(signal))}, {"signal": sign("trix - trigger")},
    ]


def aroon(window: int = 25) -> list[Stage]:
    def oldest(x: str, extreme: str) -> str:
        cases = " ".join(f"WHEN {prev(x, window - 1 - i)} = {extreme} THEN {i}" for i in range(window - 1))
        return f"CASE WHEN {extreme} IS NULL THEN NULL {cases} ELSE {window - 1} END"

    return [
        {"hh": roll("max", "high", window), "ll": roll("min", "low", window)},
        {"up": oldest("high", "hh"), "down": oldest("low", "ll")},
        {"signal": side("up > down", "up < down")},
    ]


def chaikin_money_flow(window: int = 20, threshold: float = 0.05) -> list[Stage]:
    return [
        {"mfv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0.0) * volume"},
        {"cmf": f"({roll('sum', 'mfv', window)}) / nullif({roll('sum', 'volume', window)}, 0)"},
        {"signal": side(f"cmf > {threshold}", f"cmf < -{threshold}")},
    ]


def vwap_reversion(window: int = 20, threshold: float = 0.02) -> list[Stage]:
    return [
        {"tpv": "(high + low + close) / 3 * volume"},
        {"vwap": f"({roll('sum', 'tpv', window)}) / nullif({roll('sum', 'volume', window)}, 0)"},
        {"dev": "(close - vwap) / nullif(vwap, 0)"},
        {"signal": side(f"dev < -{threshold}", f"dev > {threshold}")},
    ]


def _adx(window: int) -> list[Stage]:
    a = 1 / window
    return [
        {"tr": TRUE_RANGE, "um": f"high - {prev('high')}", "dm": f"{prev('low')} - low"},
        {"pdm": "CASE WHEN um > dm AND um > 0 THEN um ELSE 0.0 END", "mdm": "CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0.0 END"},
        {"atr": Ewm("tr", a), "pe": Ewm("pdm", a), "me": Ewm("mdm", a)},
        {"pdi": "CASE WHEN atr > 0 THEN 100 * pe / nullif(atr, 0) ELSE 0.0 END", "mdi": "CASE WHEN atr > 0 THEN 100 * me / nullif(atr, 0) ELSE 0.0 END"},
        {"dx": "CASE WHEN pdi + mdi > 0 THEN 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) ELSE 0.0 END"},
        {"adx": Ewm("dx", a)},
    ]


def adx(window: int = 14, threshold: float = 25) -> list[Stage]:
    return [*_adx(window), {"signal": side(f"adx > {threshold} AND pdi > mdi", f"adx > {threshold} AND mdi > pdi")}]


def connors_rsi(window: int = 2, oversold: float = 10, overbought: float = 90) -> list[Stage]:
    return [*_gains(), {"ag": Ewm("gain", 1 / window), "al": Ewm("loss", 1 / window)}, {"rsi": _RSI}, {"signal": side(f"rsi < {oversold}", f"rsi > {overbought}")}]


def fifty_two_week_high(window: int = 252, near_high: float = 0.95, near_low: float = 0.70) -> list[Stage]:
    return [{"top": roll("max", "close", window, least=1)}, {"signal": side(f"close / top >= {near_high}", f"close / top <= {near_low}")}]


def ultimate_oscillator(oversold: float = 30, overbought: float = 70) -> list[Stage]:
    part = lambda n: f"({roll('sum', 'bp', n)}) / nullif({roll('sum', 'tr', n)}, 0)"
    return [
        {"tl": f"least(low, {prev('close')})", "th": f"greatest(high, {prev('close')})"},
        {"bp": "close - tl", "tr": "th - tl"},
        {"a7": part(7), "a14": part(14), "a28": part(28)},
        {"uo": "100 * (4 * a7 + 2 * a14 + a28) / 7"},
        {"signal": side(f"uo < {oversold}", f"uo > {overbought}")},
    ]


def vol_managed_momentum(lookback: int = 60, vol: int = 20, target: float = 0.15) -> list[Stage]:
    return [
        {"r": f"close / {prev('close', lookback)} - 1", "lr": _LOG_RETURN},
        {"v": roll("var_samp", "lr", vol)},
        {"scale": f"CASE WHEN v IS NULL THEN 0.0 WHEN v = 0 THEN 1.0 ELSE least(1.0, {target**2!r} / (nullif(v, 0) * {YEAR})) END"},
        {"signal": f"{sign('r')} * scale"},
    ]


def residual_momentum(lookback: int = 120, skip: int = 20, mean: int = 60) -> list[Stage]:
    return [
        {"r": f"close / {prev('close')} - 1"},
        {"res": f"r - ({roll('avg', 'r', mean)})"},
        {"rolled": roll("sum", "res", lookback)},
        {"rm": prev("rolled", skip)},
        {"signal": side("rm > 1e-9", "rm < -1e-9")},
    ]


def overnight_gap(threshold: float = 0.02) -> list[Stage]:
    return [{"gap": f"open / {prev('close')} - 1"}, {"signal": side(f"gap < -{threshold}", f"gap > {threshold}")}]


def squeeze_breakout(window: int = 20, bb: float = 2.0, kc: float = 1.5) -> list[Stage]:
    """The first non-zero side of each run of valid rows without a squeeze, held to its end."""
    return [
        {"m": roll("avg", "close", window), "sd": roll("stddev_samp", "close", window), "tr": TRUE_RANGE},
        {"atr": roll("avg", "tr", window)},
        {"live": f"CASE WHEN sd IS NOT NULL AND atr IS NOT NULL AND NOT ({bb} * sd < {kc} * atr) THEN 1 ELSE 0 END"},
        {"run": f"sum(1 - live) OVER ({UPTO})"},
        {"raw": "CASE WHEN live = 1 AND close <> m THEN CASE WHEN close > m THEN 1.0 ELSE -1.0 END END"},
        {"side_ts": "CASE WHEN raw IS NOT NULL THEN ts END"},
        {"first_ts": "min(side_ts) OVER (PARTITION BY symbol, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"held": "max(CASE WHEN side_ts = first_ts THEN raw END) OVER (PARTITION BY symbol, run ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"signal": "CASE WHEN live = 1 THEN coalesce(held, 0.0) ELSE 0.0 END"},
    ]


def atr_channel_breakout(ma: int = 20, atr: int = 14, multiplier: float = 2.0) -> list[Stage]:
    return [
        {"tr": TRUE_RANGE, "m": roll("avg", "close", ma)},
        {"atr": Ewm("tr", 1 / atr)},
        *carried(side(f"close > m + {multiplier} * atr", f"close < m - {multiplier} * atr")),
    ]


def dual_momentum(lookback: int = 120, trend: int = 200) -> list[Stage]:
    return [
        {"r": f"close / {prev('close', lookback)} - 1", "t": roll("avg", "close", trend)},
        {"signal": "CASE WHEN r > 0 AND close > t THEN 1.0 ELSE 0.0 END"},
    ]


def regime_filtered_trend(fast: int = 20, slow: int = 50, window: int = 14, threshold: float = 25) -> list[Stage]:
    return [
        *_adx(window),
        {"f": roll("avg", "close", fast), "s": roll("avg", "close", slow)},
        {"signal": side(f"adx > {threshold} AND f > s", f"adx > {threshold} AND f < s")},
    ]


def coppock_curve(long: int = 14, short: int = 11, wma: int = 10) -> list[Stage]:
    parts = " + ".join([f"{wma} * roc"] + [f"{wma - k} * {prev('roc', k)}" for k in range(1, wma)])
    return [
        {"roc": f"close / {prev('close', long)} - 1 + close / {prev('close', short)} - 1"},
        {"coppock": f"({parts}) / {wma * (wma + 1) / 2}"},
        {"signal": sign("coppock")},
    ]


def true_strength_index(long: int = 25, short: int = 13) -> list[Stage]:
    a, b = span(long), span(short)
    return [
        {"d": f"close - {prev('close')}"}, {"ad": "abs(d)"},
        {"s1": Ewm("d", a), "a1": Ewm("ad", a)}, {"s2": Ewm("s1", b), "a2": Ewm("a1", b)},
        {"tsi": "100 * s2 / nullif(a2, 0)"}, {"signal": sign("tsi")},
    ]


def chande_momentum(window: int = 14, threshold: float = 50) -> list[Stage]:
    return [
        {"d": f"close - {prev('close')}"},
        {"up": "CASE WHEN d IS NULL THEN NULL WHEN d > 0 THEN d ELSE 0.0 END", "dn": "CASE WHEN d IS NULL THEN NULL WHEN d < 0 THEN -d ELSE 0.0 END"},
        {"su": roll("sum", "up", window), "sdn": roll("sum", "dn", window)},
        {"cmo": "100 * (su - sdn) / nullif(su + sdn, 0)"},
        {"signal": side(f"cmo < -{threshold}", f"cmo > {threshold}")},
    ]


def narrow_range_breakout(window: int = 7) -> list[Stage]:
    return [
        {"rng": "high - low"},
        {"narrow": f"CASE WHEN rng = ({roll('min', 'rng', window)}) THEN 1 ELSE 0 END"},
        {"was": prev("narrow"), "ph": prev("high"), "pl": prev("low")},
        {"signal": side("was = 1 AND close > ph", "was = 1 AND close < pl")},
    ]


def trail_inputs(entry: int = 20, atr: int = 22, multiplier: float = 3.0) -> list[Stage]:
    """Entry bounds and chandelier stops of donchian_atr_trail, before its state machine."""
    return [
        {"tr": TRUE_RANGE, "eh": before("max", "close", entry), "el": before("min", "close", entry)},
        {"atr": roll("avg", "tr", atr), "hh": roll("max", "high", atr), "ll": roll("min", "low", atr)},
        {"long_stop": f"hh - {multiplier} * atr", "short_stop": f"ll + {multiplier} * atr"},
    ]


def donchian_atr_trail(entry: int = 20, atr: int = 22, multiplier: float = 3.0) -> list[Stage]:
    """Enter on a breakout, leave on the trailing stop, perhaps re-enter on the same bar; flat while a bound is unknown.

    The position is an automaton of three states that needs no fold, for it is a cascade of two that only ever reset.
    A bar maps positions: a bound unknown, both stops hit, or an entry while the other side's stop is hit (``fixed``) leave one; else
    an entry takes only the flat to its side, and a stop takes only its own side to flat. What is left possible after an entry is
    long or short (pair 0), after a long stop flat or short (1), after a short stop long or flat (2): the last event tells the
    pair. Within it the position is the upper or the lower one, and a bar either keeps that or, if what it moves is all
    that the pair before held, sets it: again the last such event tells.
    """
    up, down = "close > eh", "close < el"
    return [
        *trail_inputs(entry, atr, multiplier),
        {
            "known": "eh IS NOT NULL AND long_stop IS NOT NULL AND short_stop IS NOT NULL",
            "side": side(up, down), "out_long": "coalesce(close < long_stop, false)", "out_short": "coalesce(close > short_stop, false)",
        },
        {"fixed": "CASE WHEN NOT known THEN 0.0 WHEN out_long AND out_short OR side > 0 AND out_short OR side < 0 AND out_long THEN side END"},
        {"event": "CASE WHEN fixed = 0 THEN 1 WHEN fixed IS NOT NULL OR side <> 0 THEN 0 WHEN out_long THEN 1 WHEN out_short THEN 2 END"},
        {"pair": "coalesce(@ffill(event)@, 1)"},
        {"was": f"coalesce({prev('pair')}, 1)"},
        {
            "set_upper": "CASE WHEN fixed IS NOT NULL THEN CASE WHEN fixed < 0 THEN 0 ELSE 1 END WHEN was = 2 AND (side > 0 OR side = 0 AND out_long) THEN 1 "
            "WHEN was = 1 AND (side < 0 OR side = 0 AND out_short) THEN 0 END",
        },
        {"upper": "coalesce(@ffill(set_upper)@, 1)"},
        {"signal": "CASE WHEN pair = 0 THEN CASE WHEN upper = 1 THEN 1.0 ELSE -1.0 END WHEN pair = 1 THEN CASE WHEN upper = 1 THEN 0.0 ELSE -1.0 END ELSE CASE WHEN upper = 1 THEN 1.0 ELSE 0.0 END END"},
    ]


def trail_fold_sql(bars: str) -> str:
    """The same rule in the other engine as what it says, bar after bar: a fold over each symbol's list of bars."""
    step = """list_append(a, CASE WHEN v[1].eh IS NULL OR v[1].ls IS NULL OR v[1].ss IS NULL THEN {'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': 0.0}
        WHEN NOT (a[-1].p > 0 AND v[1].c < v[1].ls OR a[-1].p < 0 AND v[1].c > v[1].ss) AND a[-1].p <> 0 THEN {'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': a[-1].p}
        WHEN v[1].c > v[1].eh THEN {'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': 1.0}
        WHEN v[1].c < v[1].el THEN {'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': -1.0} ELSE {'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': 0.0} END)"""
    fed = stages_sql(bars, trail_inputs())
    first = "[[{'c': 0.0, 'eh': 0.0, 'el': 0.0, 'ls': 0.0, 'ss': 0.0, 'p': 0.0}]]"
    rows = "list_transform(list({'c': close, 'eh': eh, 'el': el, 'ls': long_stop, 'ss': short_stop, 'p': 0.0} ORDER BY ts), lambda v: [v])"
    return f"""SELECT symbol, CAST(ts AS VARCHAR) AS ts, row.p AS signal FROM (SELECT symbol, unnest(tss) AS ts, unnest(walked[2:]) AS row FROM
        (SELECT symbol, list(ts ORDER BY ts) AS tss, list_reduce(list_concat({first}, {rows}), lambda a, v: {step}) AS walked FROM {fed} GROUP BY symbol))"""


SIGNALS = {
    f.__name__: f
    for f in (
        sma, momentum, mean_reversion, rsi_mean_reversion, donchian_breakout, bollinger_bands, macd_crossover, keltner_channel,
        vol_targeted_sma, trend_filtered_mean_reversion, triple_ma_alignment, williams_r, cci, stochastic_oscillator, trix, aroon,
        chaikin_money_flow, vwap_reversion, adx, connors_rsi, fifty_two_week_high, ultimate_oscillator, vol_managed_momentum,
        residual_momentum, overnight_gap, squeeze_breakout, atr_channel_breakout, dual_momentum, regime_filtered_trend,
        coppock_curve, true_strength_index, chande_momentum, narrow_range_breakout, donchian_atr_trail,
    )
}
