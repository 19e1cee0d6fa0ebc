"""Cross-sectional search over a price panel: factors x parameters x quantiles, validation, sealed holdout, gate, lifecycle.

All factors are columns of one pass over the panel; then rows (candidate, symbol, date), ranked and weighted by candidate and
date. What is validated is a return a candidate and date, however wide the panel. Unlike the single-name search, the
holdout is scored on portfolios built over all prices and cut afterwards, so that no factor warms up anew.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import factors
from quantloom.operators.factors import PANEL
from quantloom.operators.grid import Params, allocate, space_filling
from quantloom.plans import search
from quantloom.plans.engine import Query, Stage, apply_stages
from quantloom.plans.search import ROOT, Gate

QUANTILES = (0.1, 0.2, 0.3)
EMBARGO = 2
#: Exit rules of a factor that is tested forward: dates of grace, trailing window, least ratio, deepest drawdown.
GRACE, WINDOW, LEAST_SHARPE, MOST_DRAWDOWN = 21, 63, 0.0, 0.30

#: The factors and the parameters that a search tries.
FACTORS: dict[str, tuple[Callable[..., list[Stage]], list[Params]]] = {
    "xs_momentum": (factors.momentum, [{"lookback": n, "skip": k} for n in (126, 189, 252) for k in (0, 21)]),
    "xs_reversal": (factors.reversal, [{"n": n} for n in (3, 5, 10)]),
    "xs_low_volatility": (factors.low_volatility, [{"n": n} for n in (21, 63, 126)]),
    "xs_short_term_reversal_1m": (factors.reversal, [{"n": n} for n in (21, 42, 63)]),
    "xs_52w_high": (factors.high_52w, [{"n": n} for n in (126, 189, 252)]),
    "xs_residual_momentum": (factors.residual_momentum, [{"lookback": n, "skip": 21, "mean": 60} for n in (126, 189, 252)]),
    "xs_risk_adjusted_momentum": (factors.risk_adjusted_momentum, [{"n": n} for n in (63, 126, 252)]),
    "xs_composite": (factors.composite, [{}]),
    "xs_alpha34": (factors.alpha34, [{"short": a, "long": b} for a, b in ((2, 5), (3, 10), (5, 20))]),
    "xs_alpha19": (factors.alpha19, [{"lag": n} for n in (7, 14, 21)]),
}


def candidates(names: tuple[str, ...] = tuple(FACTORS), budget: int = Gate.budget, quantiles: tuple[float, ...] = QUANTILES) -> dict[str, list[Params]]:
    """Parameters with their quantile, spread over the budget."""
    grids = {f: [{**p, "quantile": q} for p, q in itertools.product(FACTORS[f][1], quantiles)] for f in sorted(names)}
    quota = allocate({f: len(g) for f, g in grids.items()}, budget)
    return {f: space_filling(g, quota[f]) for f, g in grids.items()}


def returns(panel: DataFrame, families: dict[str, list[Params]], cost: float = factors.COST) -> DataFrame:
    """(symbol = 'panel', family, config, ts, i, n, ret, net): each candidate's portfolio and, as ret, the panel at equal weight."""
    listed = [(f, c, dict(p)) for f, configs in families.items() for c, p in enumerate(configs)]
    signals: dict[tuple, int] = {}
    at = [signals.setdefault((f, *sorted((k, v) for k, v in p.items() if k != "quantile")), len(signals)) for f, _, p in listed]
    stages, scores = search.shared([FACTORS[key[0]][0](**dict(key[1:])) for key in signals], "score")
    by_time = Window.partitionBy("symbol").orderBy("ts")
    wide = apply_stages(panel.withColumn("own", F.coalesce(F.col("close") / F.lag("close").over(by_time) - 1, F.lit(0.0))), stages)
    rows = F.array(*[F.struct(F.lit(k).alias("signal"), F.col(score).alias("score")) for k, score in enumerate(scores)])
    long = wide.select("symbol", "ts", "own", F.explode(rows).alias("row")).select("symbol", "ts", "own", "row.*")
    date = Window.partitionBy("signal", "ts")
    place = F.row_number().over(Window.partitionBy("signal", "ts", F.col("score").isNull()).orderBy(F.round("score", 12), "symbol"))
    ranked = long.withColumns({"valid": F.count("score").over(date), "place": place})
    known = Window.partitionBy("signal", "symbol").orderBy("ts")
    quantiles = sorted({p["quantile"] for _, _, p in listed})

    def weight(q: float) -> Column:
        k = F.greatest(F.lit(1), F.floor(F.lit(q) * F.col("valid")))
        leg = F.when(F.col("place") > F.col("valid") - k, 1.0 / k).when(F.col("place") <= k, -1.0 / k).otherwise(0.0)
        return F.when(F.col("score").isNull() | (F.col("valid") < 2), 0.0).otherwise(leg)

    held = ranked.withColumns({f"w{j}": weight(q) for j, q in enumerate(quantiles)})
    held = held.withColumns({f"p{j}": F.coalesce(F.lag(f"w{j}").over(known), F.lit(0.0)) for j in range(len(quantiles))})
    net = lambda j: F.sum(F.col(f"p{j}") * F.col("own")) - F.sum(F.abs(F.col(f"w{j}") - F.col(f"p{j}"))) * cost
    dates = held.groupBy("signal", "ts").agg(F.avg("own").alias("ret"), *[net(j).alias(f"net{j}") for j in range(len(quantiles))])
    which = F.create_map(*[x for k in set(at) for x in (F.lit(k), F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(c).alias("config"), F.lit(quantiles.index(p["quantile"])).alias("q")) for (f, c, p), s in zip(listed, at, strict=True) if s == k]))])
    nets = F.array(*[F.col(f"net{j}") for j in range(len(quantiles))])
    out = dates.select("ts", "ret", nets.alias("nets"), F.explode(which[F.col("signal")]).alias("c")).select(
        F.lit("panel").alias("symbol"), "c.family", "c.config", "ts", "ret", F.get("nets", F.col("c.q")).alias("net")
    )
    return _renumbered(out)


def _renumbered(rows: DataFrame) -> DataFrame:
    own = Window.partitionBy("symbol", "family", "config")
    return rows.withColumns({"i": F.row_number().over(own.orderBy("ts")) - 1, "n": F.count("*").over(own)})


def split(rows: DataFrame) -> DataFrame:
    """``rows`` plus part: of every candidate the last fifth of the dates, a year at least, is holdout."""
    tail = F.greatest(F.floor(F.col("n") * search.HOLDOUT), F.lit(search.HOLDOUT_ROWS))
    return rows.where(F.col("n") - tail >= search.HEAD_ROWS).withColumn("part", F.when(F.col("i") >= F.col("n") - tail, "holdout").otherwise("head"))


def run(panel: DataFrame, gate: Gate = Gate(), names: tuple[str, ...] = tuple(FACTORS), prior: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(trials, verdict): each factor's best candidate with its report, and the gated finalist of the panel."""
    families = candidates(names, gate.budget)
    rows = keep(split(returns(panel, families)))
    head = _renumbered(rows.where("part = 'head'").drop("part"))
    trials = keep(search.repriced(search.validated(head, families, dict.fromkeys(families, EMBARGO)), prior))
    best = Window.partitionBy("symbol").orderBy(F.desc(F.round("sharpe", 12)), "family")
    finalist = trials.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    sharpe = lambda x: F.coalesce(F.when(F.stddev_samp(x) > 1e-12, F.avg(x) / F.stddev_samp(x)), F.lit(0.0)) * ROOT
    scored = rows.where("part = 'holdout'").join(F.broadcast(finalist.select("symbol", "family", "config")), ["symbol", "family", "config"]).groupBy("symbol").agg(
        sharpe("net").alias("holdout_sharpe"), (F.product(1 + F.col("net")) - 1).alias("holdout_return"), F.count("*").alias("holdout_bars"), sharpe("ret").alias("held_sharpe")
    )
    return trials, search.gated(finalist.join(scored, "symbol"), gate)


def lifecycle(forward: DataFrame) -> DataFrame:
    """Hold or retire by ``forward(family, config, ts, net, ret)``, the rows after a factor was frozen.

    Under GRACE dates it is held. Else it retires for a trailing ratio at or under the least or the panel's, or a drawdown beyond the most.
    """
    own = Window.partitionBy("family", "config")
    upto = own.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    curve = forward.withColumns({"back": F.row_number().over(own.orderBy(F.desc("ts"))), "equity": F.product(1 + F.col("net")).over(upto)})
    curve = curve.withColumn("down", F.col("equity") / F.max("equity").over(upto) - 1)
    recent = lambda x: F.when(F.col("back") <= WINDOW, F.col(x))
    sharpe = lambda x: F.coalesce(F.when(F.stddev_samp(recent(x)) > 1e-12, F.avg(recent(x)) / F.stddev_samp(recent(x))), F.lit(0.0)) * ROOT
    judged = curve.groupBy("family", "config").agg(F.count("*").alias("n"), sharpe("net").alias("sharpe"), sharpe("ret").alias("held_sharpe"), F.least(-F.min("down"), F.lit(1.0)).alias("drawdown"))
    reasons = F.array_compact(F.array(
        F.when(F.col("sharpe") <= LEAST_SHARPE, "decayed"), F.when(F.col("drawdown") > MOST_DRAWDOWN, "drawdown"), F.when(F.col("sharpe") <= F.col("held_sharpe"), "behind the panel"),
    ))
    judged = judged.withColumn("reasons", F.when(F.col("n") < GRACE, F.array(F.lit("grace"))).otherwise(reasons))
    return judged.withColumn("state", F.when((F.col("n") < GRACE) | (F.size("reasons") == 0), "hold").otherwise("retire"))


FROZEN = "1999-06-30"
#: The registered search: two or three candidates of every factor.
BUDGET = Gate(budget=24)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    config = lambda: F.col("config").cast("long").alias("config")
    rows = lambda s, d: returns(PANEL.frame(s, d), candidates(budget=BUDGET.budget))
    searched = lambda s, d: run(PANEL.frame(s, d), BUDGET, keep=search._kept)
    return {
        "xs_search_trials": lambda s, d: search._moments(split(rows(s, d)).where("part = 'head'")).select("family", config(), "n", *six("sharpe")),
        "xs_search_reports": lambda s, d: searched(s, d)[0].select("family", config(), *six("sharpe", "margin", "probability", "pbo", "stability", "walk_oos", "purged_oos")),
        "xs_search_verdict": lambda s, d: searched(s, d)[1].select("family", "passed", F.array_join("reasons", ",").alias("reasons"), *six("sharpe", "margin", "holdout_sharpe", "held_sharpe", "holdout_return")),
        "xs_lifecycle": lambda s, d: lifecycle(rows(s, d).where(F.col("ts") > F.lit(FROZEN).cast("date"))).select("family", config(), "n", "state", F.array_join("reasons", ",").alias("reasons"), *six("sharpe", "held_sharpe", "drawdown")),
    }


def _portfolio_sql() -> str:
    """Every candidate by itself: (family, config, ts, net, ret)."""
    parts = []
    for family, configs in candidates(budget=BUDGET.budget).items():
        for k, p in enumerate(configs):
            params = {x: v for x, v in p.items() if x != "quantile"}
            stages = [*FACTORS[family][0](**params), *factors.weights(p["quantile"]), {"own": f"coalesce(close / {factors.prev('close')} - 1, 0.0)", "pw": f"coalesce({factors.prev('w')}, 0.0)"}]
            parts.append(Query(PANEL, stages, f"SELECT '{family}' AS family, CAST({k} AS BIGINT) AS config, ts, sum(pw * own) - sum(abs(w - pw)) * {factors.COST} AS net, avg(own) AS ret FROM {{t}} GROUP BY ts").sql())
    return " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    sharpe = lambda x: f"coalesce(CASE WHEN stddev_samp({x}) > 1e-12 THEN {ROOT!r} * avg({x}) / stddev_samp({x}) END, 0.0)"
    base = f"WITH r AS MATERIALIZED ({_portfolio_sql()}), m AS (SELECT *, row_number() OVER (PARTITION BY family, config ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY family, config) AS n FROM r) "
    tail = f"greatest(CAST(floor({search.HOLDOUT} * n) AS BIGINT), {search.HOLDOUT_ROWS})"
    window = "PARTITION BY family, config ORDER BY ts"
    return {
        "xs_search_trials": base + f"SELECT family, config, count(*) AS n, round({sharpe('net')}, 6) AS sharpe FROM m WHERE i < n - {tail} AND n - {tail} >= {search.HEAD_ROWS} GROUP BY family, config",
        "xs_lifecycle": base + f""", f AS (SELECT *, row_number() OVER (PARTITION BY family, config ORDER BY ts DESC) AS back, product(1 + net) OVER ({window} ROWS UNBOUNDED PRECEDING) AS e FROM r WHERE ts > DATE '{FROZEN}'),
            g AS (SELECT *, e / max(e) OVER ({window} ROWS UNBOUNDED PRECEDING) - 1 AS down FROM f),
            x AS (SELECT family, config, count(*) AS n, {sharpe('CASE WHEN back <= 63 THEN net END')} AS sharpe, {sharpe('CASE WHEN back <= 63 THEN ret END')} AS held_sharpe, least(-min(down), 1) AS drawdown FROM g GROUP BY family, config),
            y AS (SELECT *, CASE WHEN n < 21 THEN 'grace' ELSE array_to_string(list_filter([CASE WHEN sharpe <= 0 THEN 'decayed' END, CASE WHEN drawdown > 0.3 THEN 'drawdown' END, CASE WHEN sharpe <= held_sharpe THEN 'behind the panel' END], lambda v: v IS NOT NULL), ',') END AS reasons FROM x)
            SELECT family, config, n, CASE WHEN n < 21 OR reasons = '' THEN 'hold' ELSE 'retire' END AS state, reasons, round(sharpe, 6) AS sharpe, round(held_sharpe, 6) AS held_sharpe, round(drawdown, 6) AS drawdown FROM y""",
    }
