"""The trailing stop's position one bar at a time, for streams; over stored bars it is a signal of windows."""

from __future__ import annotations

import pandas as pd


def stepped(held: float, close: float, up: float, down: float, stop: float, cover: float) -> float:
    """Enter on a breakout, leave on the trailing stop, perhaps re-enter on the same bar; flat while a bound is unknown."""
    if pd.isna(up) or pd.isna(stop) or pd.isna(cover):
        return 0.0
    if held > 0 and close < stop or held < 0 and close > cover:
        held = 0.0
    return held or (1.0 if close > up else -1.0 if close < down else 0.0)
