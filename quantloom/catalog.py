"""Every registered query of the research engine, with its SQL oracle."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from quantloom.operators import book, data_quality, factors, forward, fundamentals, kernel, lab, pool, quality_checks, simulation, tape, validation, valuation
from quantloom.operators.signals import SIGNALS, trail_fold_sql
from quantloom.plans import calibration, factor_book, hunt, panel_search, search
from quantloom.plans.engine import Query
from quantloom.sources import edgar
from quantloom.sources.bars import BARS


def _dated(q: Query) -> Query:
    """Dates leave as ISO text, which reads the same from any engine and driver."""
    select = re.sub(r"^SELECT (symbol, )?(\w+, )?ts\b", r"SELECT \1\2CAST(ts AS STRING) AS ts", q.select)
    select = re.sub(r"\b(min|max)\(ts\) AS (ts|since|until)\b(?=.* FROM \{t\} GROUP BY symbol(, (part|run)\b.*)?$)", r"CAST(\1(ts) AS STRING) AS \2", select)
    return replace(q, select=select)


def _declared() -> dict[str, Query]:
    out = {"bars_ohlcv": Query(BARS, [], "SELECT symbol, ts, round(open, 9) open, round(high, 9) high, round(low, 9) low, round(close, 9) close, volume FROM {t}")}
    out |= {f"sig_{name}": Query(BARS, make(), "SELECT symbol, ts, round(signal, 6) AS signal FROM {t}") for name, make in SIGNALS.items()}
    for module in (kernel, data_quality, factors, validation, lab, book, valuation):
        out |= module.declared()
    return {name: _dated(q) for name, q in out.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_declared(), **edgar.queries(), **fundamentals.queries(), **pool.queries(), **quality_checks.queries(), **search.queries(), **panel_search.queries(), **hunt.queries(), **factor_book.queries(), **tape.queries(), **forward.queries(), **calibration.queries(), **simulation.queries()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql() for name, q in _declared().items()} | {"sig_donchian_atr_trail": trail_fold_sql(BARS.sql)} | edgar.oracle_sql() | fundamentals.oracle_sql() | pool.oracle_sql() | quality_checks.oracle_sql() | search.oracle_sql() | panel_search.oracle_sql() | hunt.oracle_sql() | tape.oracle_sql() | forward.oracle_sql() | simulation.oracle_sql()
