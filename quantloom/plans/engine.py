"""Declarative queries: a base relation, staged window projections and a final SELECT.

A stage is a set of columns computed side by side. All stages of a query share one window
key, so Spark plans one exchange and sort for the whole chain however many stages it has.
The same declaration renders as DuckDB SQL, which is the oracle; what the dialects spell
differently is written as ``@name(args)@``.

Two things are not rendered but computed otherwise than the oracle does. Wide rolling windows come from tables of
spans of 2, 4, 8, ... rows, each made of two of the one before, so a row costs the logarithm of the frame
and all windows of a column share the tables. Recursive averages are running sums of blocks whose weights stay within a double.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

KEYED = "PARTITION BY symbol ORDER BY ts"
UPTO = f"{KEYED} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@dataclass(frozen=True)
class Ewm:
    """y = (1 - alpha) * y' + alpha * x from the first non-null x on; nulls only lead."""

    column: str
    alpha: float


@dataclass(frozen=True)
class RunningProduct:
    column: str


Stage = dict[str, "str | Ewm | RunningProduct"]

#: Rolling frames of fewer rows are read row by row; from here on the tables are faster (252 rows: 3 to 5 times, 500: 5 to 9).
WIDE = 64
#: Rows of a block of a recursive average, and the greatest exponent of e of a weight in it.
BLOCK, STEEPEST = 512, 560.0
#: What decays by this exponent is below a double's last digit.
GONE = 40.0


def _rolling(agg: str, x: str, n: str, least: str) -> str:
    frame = f"({KEYED} ROWS BETWEEN {int(n) - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {least} THEN {agg}({x}) OVER {frame} END"


_SPARK = {
    "roll": _rolling,
    "ffill": lambda x: f"last_value({x}, true) OVER ({UPTO})",
    "pct": lambda x, p: f"percentile({x}, {p})",
    "days": lambda a, b: f"datediff({a}, {b})",
    "weekday": lambda d: f"weekday({d})",
    "json": lambda c, k: f"get_json_object({c}, '$.{k}')",
    "fits": lambda c, p: f"{c} RLIKE '{p}'",
    "long": lambda x, n: "stack(" + n + ", " + ", ".join(f"{k}, {x}{k}" for k in range(int(n))) + f") AS (config, {x})",
    "bit": lambda m, k: f"(shiftright({m}, {k}) & 1)",
}
_DUCK = {
    "roll": _rolling,
    "ffill": lambda x: f"last_value({x} IGNORE NULLS) OVER ({UPTO})",
    "pct": lambda x, p: f"quantile_cont({x}, {p})",
    "days": lambda a, b: f"date_diff('day', {b}, {a})",
    "weekday": lambda d: f"(isodow({d}) - 1)",
    "json": lambda c, k: f"json_extract_string({c}, '$.{k}')",
    "fits": lambda c, p: f"regexp_full_match({c}, '{p}')",
    "long": lambda x, n: f"unnest(range({n})) AS config, unnest([" + ", ".join(f"{x}{k}" for k in range(int(n))) + f"]) AS {x}",
    "bit": lambda m, k: f"((CAST({m} AS BIGINT) >> CAST({k} AS INT)) & 1)",
}


def render(sql: str, dialect: dict[str, Callable[..., str]]) -> str:
    """Expand the @macros@; Spark would read 1.0 as a decimal, so it gets 1.0D."""
    if dialect is _SPARK:
        sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1D", sql)
    return re.sub(r"@(\w+)\((.*?)\)@", lambda m: dialect[m[1]](*(a.strip() for a in m[2].split(";"))), sql)


def _key() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("ts")


def _upto(last: int = 0) -> WindowSpec:
    return _key().rowsBetween(Window.unboundedPreceding, last)


def with_ewms(df: DataFrame, ewms: dict[str, Ewm]) -> DataFrame:
    """``df`` plus recursive averages by name.

    Within a block of rows y is a running sum of x by growing weights, scaled back. What an earlier block adds
    decays with the distance of its end; the ends are added up in doubling steps as far as they count.
    """
    had, weights = df.columns, {}
    for name, e in ewms.items():
        fall = -math.log(1 - e.alpha) if e.alpha < 1 else math.inf
        rows = BLOCK
        while rows > 1 and rows * fall > STEEPEST:
            rows //= 2
        weights[name] = (fall, rows)
    counts = {f"_n_{x}": F.count(x).over(_upto()) for x in {e.column for e in ewms.values()}}
    df = df.withColumns({"_i": F.row_number().over(_key()) - 1, **counts})
    blocks = {rows: (F.expr(f"_i div {rows}"), F.col("_i") % rows) for _, rows in weights.values()}
    df = df.withColumns({f"_{k}{rows}": x for rows, pair in blocks.items() for k, x in zip("bj", pair, strict=True)})
    sums = {}
    for name, e in ewms.items():
        fall, rows = weights[name]
        if fall < math.inf:
            x = F.when(F.col(f"_n_{e.column}") == 1, F.col(e.column) / e.alpha).otherwise(F.col(e.column))
            grown = F.coalesce(x, F.lit(0.0)) * F.pow(F.lit(1 - e.alpha), -F.col(f"_j{rows}"))
            sums[f"_u_{name}"] = F.sum(grown).over(Window.partitionBy("symbol", f"_b{rows}").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns(sums)
    local = {n: e.alpha * F.pow(F.lit(1 - e.alpha), F.col(f"_j{weights[n][1]}")) * F.col(f"_u_{n}") for n, e in ewms.items() if f"_u_{n}" in sums}
    df = df.withColumns({f"_end_{n}": F.when(F.col(f"_j{weights[n][1]}") == weights[n][1] - 1, x) for n, x in local.items()} | {f"_loc_{n}": x for n, x in local.items()})
    step = 1
    while wanted := [n for n in local if weights[n][0] * weights[n][1] * step < GONE]:
        df = df.withColumns({
            f"_end_{n}": F.col(f"_end_{n}") + math.exp(-weights[n][0] * weights[n][1] * step) * F.coalesce(F.lag(f"_end_{n}", weights[n][1] * step).over(_key()), F.lit(0.0)) for n in wanted
        })
        step *= 2
    carried = {n: F.coalesce(F.last(f"_end_{n}", ignorenulls=True).over(_upto(-1)), F.lit(0.0)) for n in local}
    made = {}
    for name, e in ewms.items():
        value = F.col(e.column) if name not in local else F.col(f"_loc_{name}") + F.pow(F.lit(1 - e.alpha), F.col(f"_j{weights[name][1]}") + 1) * carried[name]
        made[name] = F.when(F.col(f"_n_{e.column}") == 1, F.col(e.column)).when(F.col(f"_n_{e.column}") > 1, value)
    return df.withColumns(made).select(*had, *ewms)


Roll = tuple[str, str, int, int]
_ROLL = re.compile(r"@roll\((\w+);\s*(\w+);\s*(\d+);\s*(\d+)\)@")
_EXTREMES = {"max": F.greatest, "min": F.least}


def rolls_of(expressions: Iterable[object]) -> set[Roll]:
    """The wide windows that expressions ask for; narrow ones, and partial ones but of extremes, are read row by row."""
    found = {(m[1], m[2], int(m[3]), int(m[4])) for e in expressions if isinstance(e, str) for m in _ROLL.finditer(e)}
    return {r for r in found if r[2] >= WIDE and (r[3] == r[2] or r[0] in _EXTREMES)}


def _name(roll: Roll) -> str:
    return "_roll_{}_{}_{}_{}".format(*roll)


def with_rolls(df: DataFrame, rolls: set[Roll]) -> DataFrame:
    """``df`` plus a column for each rolling window, from tables of doubling spans."""
    kinds = {(agg if agg in _EXTREMES else "sum", x) for agg, x, *_ in rolls} | {("m2", x) for agg, x, *_ in rolls if agg not in (*_EXTREMES, "avg", "sum")}
    height = {}
    for agg, x, n, _ in rolls:
        for kind in kinds:
            if kind[1] == x and (kind[0] == agg or agg not in _EXTREMES and kind[0] not in _EXTREMES):
                height[kind] = max(height.get(kind, 0), n.bit_length() - 1)
    at = lambda kind, x, k: f"_{kind}_{x}_{k}"
    columns = {x for _, x, *_ in rolls}
    partial = {(agg, x) for agg, x, n, least in rolls if least < n}
    df = df.withColumns({
        "_i": F.row_number().over(_key()), **{f"_c_{x}": F.count(x).over(_upto()) for x in columns}, **{f"_top_{agg}_{x}": F.expr(f"{agg}({x})").over(_upto()) for agg, x in partial},
        **{at(kind, x, 0): F.col(x) if kind in _EXTREMES else F.coalesce(F.col(x).cast("double"), F.lit(0.0)) if kind == "sum" else F.lit(0.0) for kind, x in kinds},
    })
    for k in range(max(height.values())):
        span, level = 1 << k, {}
        back = lambda kind, x: F.lag(at(kind, x, k), span).over(_key())  # noqa: B023, E731
        for kind, x in kinds:
            if height[kind, x] <= k:
                continue
            own = F.col(at(kind, x, k))
            if kind in _EXTREMES:
                level[at(kind, x, k + 1)] = _EXTREMES[kind](own, back(kind, x))
            elif kind == "sum":
                level[at(kind, x, k + 1)] = own + F.coalesce(back(kind, x), F.lit(0.0))
            else:
                apart = F.col(at("sum", x, k)) - F.coalesce(back("sum", x), F.lit(0.0))
                level[at(kind, x, k + 1)] = own + F.coalesce(back(kind, x), F.lit(0.0)) + apart * apart / (2.0 * span)
        df = df.withColumns(level)
    parts = {roll: _spans(roll) for roll in rolls}
    kind_of = lambda roll: [roll[0]] if roll[0] in _EXTREMES else ["sum"] if roll[0] in ("avg", "sum") else ["sum", "m2"]
    lags = {f"{at(kind, roll[1], k)}_{o}": F.lag(at(kind, roll[1], k), o).over(_key()) for roll, spans in parts.items() for k, o in spans if o for kind in kind_of(roll)}
    df = df.withColumns(lags | {f"_c_{x}_{n}": F.lag(f"_c_{x}", n).over(_key()) for _, x, n, _ in rolls})
    get = lambda kind, x, k, o: F.col(f"{at(kind, x, k)}_{o}" if o else at(kind, x, k))
    return df.withColumns({_name(roll): _combined(roll, spans, get) for roll, spans in parts.items()})


def _spans(roll: Roll) -> list[tuple[int, int]]:
    """(height, rows back) of the spans that make up a window: two that may overlap for an extreme, else the binary digits."""
    agg, _, n, _ = roll
    if agg in _EXTREMES:
        k = n.bit_length() - 1
        return [(k, 0), (k, n - (1 << k))] if n > 1 << k else [(k, 0)]
    out, back = [], 0
    for k in reversed(range(n.bit_length())):
        if n >> k & 1:
            out.append((k, back))
            back += 1 << k
    return out


def _combined(roll: Roll, spans: list[tuple[int, int]], get: Callable[..., Column]) -> Column:
    agg, x, n, least = roll
    full = F.col(f"_c_{x}") - F.coalesce(f"_c_{x}_{n}", F.lit(0)) >= least
    if agg in _EXTREMES:
        both = [get(agg, x, *s) for s in spans]
        best = _EXTREMES[agg](*both) if len(both) > 1 else both[0]
        return F.when(full, F.when(F.col("_i") < n, F.col(f"_top_{agg}_{x}")).otherwise(best) if least < n else best)
    total, square, count = get("sum", x, *spans[0]), F.lit(0.0), 1 << spans[0][0]
    moments = agg not in ("avg", "sum")
    square = get("m2", x, *spans[0]) if moments else square
    for k, back in spans[1:]:
        other, size = get("sum", x, k, back), 1 << k
        if moments:
            apart = total * size - other * count
            square = square + get("m2", x, k, back) + apart * apart / (float(count) * size * (count + size))
        total, count = total + other, count + size
    if not moments:
        return F.when(full, total if agg == "sum" else total / n)
    var = F.when(square > 1e-22 * total * total / n, square / (n - 1)).otherwise(0.0)  # less is what the sums were rounded by
    return F.when(full, var if agg == "var_samp" else F.sqrt(var))


def _column(e: str | RunningProduct, wide: set[Roll]) -> Column:
    if isinstance(e, RunningProduct):
        return F.product(F.col(e.column)).over(_upto())
    return F.expr(render(_ROLL.sub(lambda m: _name(r) if (r := (m[1], m[2], int(m[3]), int(m[4]))) in wide else m[0], e), _SPARK))


def apply_stages(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        if again := set(stage) & set(df.columns):
            raise ValueError(f"columns are computed twice: {sorted(again)}")
        had, wide = df.columns, rolls_of(stage.values())
        ewms = {name: e for name, e in stage.items() if isinstance(e, Ewm)}
        df = with_rolls(df, wide) if wide else df
        df = df.withColumns({name: _column(e, wide) for name, e in stage.items() if name not in ewms})
        df = with_ewms(df, ewms) if ewms else df
        df = df.select(*had, *stage) if wide else df
    return df


def stages_sql(relation: str, stages: list[Stage]) -> str:
    for stage in stages:
        plain = [(n, e) for n, e in stage.items() if not isinstance(e, Ewm)]
        body = ", ".join(
            ["*"] + [f"product({e.column}) OVER ({UPTO}) AS {n}" if isinstance(e, RunningProduct) else f"{render(e, _DUCK)} AS {n}" for n, e in plain]
        )
        had = relation
        relation = f"(SELECT {body} FROM {relation})"
        for n, e in stage.items():
            if isinstance(e, Ewm):
                fold = (
                    f"list_reduce(list_transform(list({e.column} ORDER BY ts), lambda v: [v]), lambda a, v: list_append(a, "
                    f"CASE WHEN a[-1] IS NULL THEN v[1] ELSE {1 - e.alpha!r} * a[-1] + {e.alpha!r} * v[1] END))"
                )
                relation = (
                    f"(SELECT l.*, r.{n} FROM {relation} l JOIN (SELECT symbol, unnest(tss) ts, unnest(ys) {n} FROM "
                    f"(SELECT symbol, list(ts ORDER BY ts) tss, {fold} ys FROM {had} GROUP BY symbol)) r USING (symbol, ts))"
                )
    return relation


def tally(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


@dataclass(frozen=True)
class Base:
    """A relation for both engines: frame(spark, sf_dir) and a SQL subquery."""

    frame: Callable[[SparkSession, str], DataFrame]
    sql: str


@dataclass(frozen=True)
class Query:
    """SELECT over {t}, the base with its stages; {name} are further bases."""

    base: Base
    stages: list[Stage] = field(default_factory=list)
    select: str = "SELECT * FROM {t}"
    others: dict[str, Base] = field(default_factory=dict)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {k: b.frame(spark, sf_dir) for k, b in self.others.items()}
        frames["t"] = apply_stages(self.base.frame(spark, sf_dir), self.stages)
        return spark.sql(render(self.select, _SPARK), **{k: v for k, v in frames.items() if "{" + k + "}" in self.select})

    def sql(self) -> str:
        parts = {k: b.sql for k, b in self.others.items()}
        parts["t"] = stages_sql(self.base.sql, self.stages)
        return render(re.sub(r"\{(\w+)\}", lambda m: parts[m[1]], self.select), _DUCK)

    def as_base(self) -> Base:
        return Base(self.__call__, f"({self.sql()})")
