"""State that depends on the order of bars, over streams that bring them out of order.

A bar waits in its symbol's list state until the watermark has passed it; an event-time timer then takes what waits up to
there, in the order of time, through a fold whose state is a value of its own. So any order of arrival within the watermark gives
what the sorted bars would, a bar that comes twice counts once, and the state of a symbol that has been silent for long is dropped. Needs the
RocksDB state store.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quantloom.operators.stateful import stepped

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
YEAR = 252
Step = Callable[[tuple, tuple], tuple[tuple, tuple]]


class InOrder(StatefulProcessor):
    """Folds rows (at, ...) of a key in the order of ``at`` (milliseconds): ``step(state, row)`` gives the new state and what to emit behind the key.

    ``last``: of the rows that a timer releases only the last result is emitted. ``idle``: milliseconds after which a silent key's state goes.
    """

    def __init__(self, fields: str, state: str, start: tuple, step: Step, names: list[str], *, last: bool, idle: int) -> None:
        self.fields, self.state, self.start, self.step, self.names, self.last, self.idle = fields, state, start, step, names, last, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.held = handle.getValueState("held", f"seen long, {self.state}")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for row in rows:
            self.waiting.appendValue(tuple(row)[1:-1])
            self.handle.registerTimer(row["at"])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in waiting if r[0] <= now], [r for r in waiting if r[0] > now]
        seen, *state = self.held.get() if self.held.exists() else (None, *self.start)
        if not due:
            if not later and seen is not None and now >= seen + self.idle:
                self.held.clear()
            return
        out = []
        for row in due:
            if seen is None or row[0] > seen:
                seen = row[0]
                state, result = self.step(tuple(state), tuple(row))
                out.append(Row(**dict(zip(self.names, (*key, *result), strict=True))))
        self.held.update((seen, *state))
        self.waiting.clear()
        if later:
            self.waiting.put([tuple(r) for r in later])
        self.handle.registerTimer(seen + self.idle)
        yield from out[-1:] if self.last else out

    def close(self) -> None:
        pass


def _names(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def _folded(rows: DataFrame, fields: str, output: str, mode: str, state: str, start: tuple, step: Step, *, last: bool, idle: int) -> DataFrame:
    """``rows(symbol, ts, ...)``, whose ts has a watermark, through a fold by symbol."""
    names = _names(fields)
    processor = InOrder(fields, state, start, step, _names(output), last=last, idle=idle)
    timed = rows.withColumn("at", F.unix_millis(F.col("ts").cast("timestamp"))).select("symbol", *names, "ts")
    return timed.groupBy("symbol").transformWithState(processor, output, mode, "EventTime")


def _stop(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    held = stepped(state[0], *(math.nan if x is None else x for x in row[1:6]))
    return (held,), (row[0], held)


def trailing_positions(fed: DataFrame, idle: int = 400 * 86_400_000) -> DataFrame:
    """(symbol, ts, signal) of a stream (symbol, ts, close, eh, el, long_stop, short_stop): the trailing stop, whatever the order of arrival."""
    fields = "at long, close double, eh double, el double, long_stop double, short_stop double"
    out = _folded(fed, fields, "symbol string, at long, signal double", "append", "held double", (0.0,), _stop, last=False, idle=idle)
    return out.select("symbol", F.timestamp_millis("at").alias("ts"), "signal")


_SCORE = "n long, total double, square double, wealth double, peak double, worst double, held double, held_total double, held_square double"


def _score(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Counts, sums and squares of the net return and of holding, both wealths, the peak and the deepest fall from it."""
    n, total, square, wealth, peak, worst, held, held_total, held_square = state
    _, net, ret = row[:3]
    wealth, held = wealth * (1 + net), held * (1 + ret)
    peak = max(peak, wealth)
    state = (n + 1, total + net, square + net * net, wealth, peak, min(worst, wealth / peak - 1), held, held_total + ret, held_square + ret * ret)
    return state, (row[0], *state)


def forward_scores(returns: DataFrame, idle: int = 4000 * 86_400_000) -> DataFrame:
    """Scores of ``returns(symbol, ts, net, ret, frozen_at)`` after the freeze, a row a symbol whenever bars become final.

    (symbol, as_of, n, forward_return, sharpe, drawdown, held_return, held_sharpe, beats_held). A restart goes on from the checkpoint's state.
    """
    after = returns.where(F.col("ts") > F.col("frozen_at"))
    fields = "at long, net double, ret double"
    start = (0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0)
    out = _folded(after, fields, f"symbol string, at long, {_SCORE}", "update", _SCORE, start, _score, last=True, idle=idle)

    def sharpe(total: str, square: str) -> Column:
        var = (F.col(square) - F.col(total) * F.col(total) / F.col("n")) / (F.col("n") - 1)
        return F.coalesce(F.when((F.col("n") > 1) & (var > 1e-24), math.sqrt(YEAR) * F.col(total) / F.col("n") / F.sqrt(var)), F.lit(0.0))

    scored = out.select(
        "symbol", F.timestamp_millis("at").alias("as_of"), "n", (F.col("wealth") - 1).alias("forward_return"), sharpe("total", "square").alias("sharpe"), F.col("worst").alias("drawdown"),
        (F.col("held") - 1).alias("held_return"), sharpe("held_total", "held_square").alias("held_sharpe"),
    )
    return scored.withColumn("beats_held", F.col("sharpe") > F.col("held_sharpe"))
