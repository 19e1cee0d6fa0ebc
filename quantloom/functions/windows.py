"""SQL window snippets over ``PARTITION BY symbol ORDER BY ts``."""

from __future__ import annotations

from quantloom.plans.engine import KEYED


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """Aggregate of the last n rows of a column, null until n (or ``least``) of them have a value."""
    return f"@roll({agg}; {x}; {n}; {least or n})@"


def before(agg: str, x: str, n: int) -> str:
    """Aggregate of the n rows before this one, null until there are n."""
    frame = f"({KEYED} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END"


def prev(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({KEYED})"


def side(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1.0 WHEN {down} THEN -1.0 ELSE 0.0 END"


def sign(x: str) -> str:
    return side(f"{x} > 0", f"{x} < 0")


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {low}), {high})"


def compounded(x: str) -> str:
    """Compounded return of a group's returns, losses of the whole and more included."""
    grown = f"(1 + {x})"
    sign = f"(CASE WHEN sum(CASE WHEN {grown} < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END)"
    return f"(CASE WHEN min(abs{grown}) = 0 THEN 0.0 ELSE {sign} * exp(sum(ln(nullif(abs{grown}, 0)))) END - 1)"
