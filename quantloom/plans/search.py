"""Search over signal families: all candidates in one window pass, validation of each family, refinement, sealed holdout, gate.

The bars are split first. Everything up to the finalist sees the head alone; the holdout is scored once, by the
finalist, with its indicators warming up anew. Candidates are columns of one pass over the bars (a sort by symbol and time),
then rows (symbol, family, config, bar); validation combines sufficient statistics of segments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quantloom.operators import grid
from quantloom.operators.factors import ALL_BARS
from quantloom.operators.grid import CATALOG, Params, allocate, canonical, space_filling
from quantloom.operators.kernel import COST, YEAR, run
from quantloom.operators.signals import SIGNALS
from quantloom.operators.statistics import expected_max_sharpe, probabilistic_sharpe
from quantloom.plans.engine import Base, Ewm, RunningProduct, Stage, apply_stages

ROOT = math.sqrt(YEAR)
HOLDOUT, HOLDOUT_ROWS, HEAD_ROWS = 0.2, 252, 252
GROUPS, WALKS, FOLDS, LEAST_EMBARGO = 10, 5, 5, 2
#: A family is validated on no fewer candidates.
LEAST_CONFIGS = 2


@dataclass(frozen=True)
class Gate:
    """Graduation thresholds."""

    margin: float = 0.0
    pbo: float = 0.5
    stability: float = 0.4
    holdout: float = 0.0
    beat_holding: bool = True
    budget: int = 200

    @property
    def version(self) -> str:
        return grid.parameter_hash(vars(self))


def split(bars: DataFrame) -> DataFrame:
    """``bars`` plus i, n and part ('head' or 'holdout'): the last fifth, a year at least; symbols whose head is under a year go."""
    key = Window.partitionBy("symbol")
    tail = F.greatest(F.floor(F.col("n") * HOLDOUT), F.lit(HOLDOUT_ROWS))
    counted = bars.withColumns({"i": F.row_number().over(key.orderBy("ts")) - 1, "n": F.count("*").over(key)})
    return counted.where(F.col("n") - tail >= HEAD_ROWS).withColumn("part", F.when(F.col("i") >= F.col("n") - tail, "holdout").otherwise("head"))


def _renamed(e: object, names: dict[str, str]) -> object:
    """The expression with the columns of earlier stages by their shared names."""
    if not names:
        return e
    made = re.compile(rf"(?<![\w.'])({'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})\b(?!\s*\()")
    mark = lambda text: made.sub(lambda m: names[m[1]], text)
    if isinstance(e, Ewm):
        return Ewm(mark(e.column), e.alpha)
    return RunningProduct(mark(e.column)) if isinstance(e, RunningProduct) else mark(e)


def shared(candidates: list[list[Stage]], last: str = "signal") -> tuple[list[Stage], list[str]]:
    """The stages of all candidates as one list, and the column of each one's ``last``.

    What several candidates compute alike (true ranges, averages of the same window) is computed once.
    """
    stages: list[Stage] = [{} for _ in range(max(map(len, candidates)))]
    known: dict[object, str] = {}
    names: list[dict[str, str]] = [{} for _ in candidates]
    for depth in range(len(stages)):
        for k, own in enumerate(candidates):
            if depth >= len(own):
                continue
            moved = {name: _renamed(e, names[k]) for name, e in own[depth].items()}
            for name, e in moved.items():
                if e not in known:
                    known[e] = f"{name}__{len(known)}"
                    stages[depth][known[e]] = e
            names[k] |= {name: known[e] for name, e in moved.items()}
    return [stage for stage in stages if stage], [own[last] for own in names]


def _net(position: Column, ret: Column, w: Window) -> Column:
    """Net return of a position: it earns the next bar's return, a change of it costs."""
    before = F.lag(position).over(w)
    return F.coalesce(before, F.lit(0.0)) * ret - F.coalesce(F.abs(position - before), F.abs(position)) * COST


def _clipped(signal: Column) -> Column:
    return F.when(signal.isNotNull(), F.greatest(F.least(signal, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)


def returns(bars: DataFrame, families: dict[str, list[Params]], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(symbol, family, config, ts, i, n, ret, net) of every candidate on these bars, whose i and n are numbered anew.

    ``keep`` gets a row a bar, before the candidates become rows.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    based = bars.drop("i", "n", "part").withColumns({
        "ret": F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0)), "i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol")),
    })
    listed = [(family, config, params) for family, configs in families.items() for config, params in enumerate(configs)]
    stages, signals = shared([SIGNALS[family](**params) for family, _, params in listed])
    wide = apply_stages(based, stages).withColumns({f"pos__{k}": _clipped(F.col(signal)) for k, signal in enumerate(signals)})
    nets = keep(wide.select("symbol", "ts", "i", "n", "ret", F.array(*[_net(F.col(f"pos__{k}"), F.col("ret"), w) for k in range(len(listed))]).alias("nets")))
    named = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(c).alias("config")) for f, c, _ in listed])
    rows = nets.select("symbol", "ts", "i", "n", "ret", F.posexplode("nets").alias("k", "net")).withColumn("row", F.get(named, F.col("k")))
    return rows.select("symbol", "row.family", "row.config", "ts", "i", "n", "ret", "net")


def sharpe_of(n: Column, s: Column, q: Column) -> Column:
    """Mean over standard deviation from sums; zero without spread or under two rows."""
    var = F.when(n > 1, (q - s * s / n) / (n - 1))
    return F.coalesce(F.when(var > 1e-18, s / n / F.sqrt(var)), F.lit(0.0))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("q"))


def _moments(rows: DataFrame) -> DataFrame:
    """Per candidate: n, sharpe (annualised), skew and kurtosis (bias-corrected; null under four rows or without spread)."""
    n = F.count("*")
    skew = F.skewness("net") * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("net") + 6) + 3
    sound = (n >= 4) & (F.var_pop("net") > 1e-24)
    return rows.groupBy("symbol", "family", "config").agg(
        n.alias("n"), (F.coalesce(F.when(F.stddev_samp("net") > 1e-12, F.avg("net") / F.stddev_samp("net")), F.lit(0.0)) * ROOT).alias("sharpe"),
        F.when(sound, skew).alias("skew"), F.when(sound, kurtosis).alias("kurtosis"), F.min("ts").alias("since"), F.max("ts").alias("until"),
    )


def _first_best(score: str) -> Column:
    """Order of the best candidate, of equals the first."""
    return F.struct(F.round(score, 12).alias("score"), (-F.col("config")).alias("first"))


def overfitting(rows: DataFrame) -> DataFrame:
    """(symbol, family, pbo): the share of all splits of GROUPS segments in which the best half's winner is in the other half's lower part.

    The segments' sums of a family's candidates make one row, against which each split is judged: no row a candidate and split is exchanged.
    """
    small, extra = F.floor(F.col("n") / GROUPS), F.col("n") % GROUPS
    edge = extra * (small + 1)
    group = F.when(F.col("i") < edge, F.floor(F.col("i") / (small + 1))).otherwise(extra + F.floor((F.col("i") - edge) / small)).cast("int")
    sums = _sums(rows.withColumn("g", group), "symbol", "family", "config", "g").repartition("symbol", "family")
    segments = lambda x: F.array(*[F.coalesce(F.sum(F.when(F.col("g") == g, F.col(x))), F.lit(0)) for g in range(GROUPS)]).alias(x)
    own = sums.groupBy("symbol", "family", "config").agg(*map(segments, "csq"))
    own = own.groupBy("symbol", "family").agg(F.collect_list(F.struct("config", *"csq")).alias("candidates"), F.count("*").alias("configs"))
    every = set(range(GROUPS))
    halves = [(list(half), sorted(every.difference(half))) for half in combinations(range(GROUPS), GROUPS // 2)]
    splits = F.broadcast(rows.sparkSession.createDataFrame(halves, "tr array<int>, te array<int>"))
    total = lambda c, x, side: reduce(Column.__add__, [F.get(c[x], F.col(side)[k]) for k in range(GROUPS // 2)]).alias(f"{side}_{x}")
    totals = F.transform("candidates", lambda c: F.struct(c["config"].alias("config"), *[total(c, x, side) for side in ("tr", "te") for x in "csq"]))
    score = lambda t, side: F.round(sharpe_of(*(t[f"{side}_{x}"] for x in "csq")), 12)
    scores = F.transform(totals, lambda t: F.struct(score(t, "te").alias("te"), t["config"].alias("config"), score(t, "tr").alias("tr")))
    scored = own.crossJoin(splits).select("symbol", "family", "configs", scores.alias("scores"))
    winner = F.array_max(F.transform("scores", lambda x: F.struct(x["tr"].alias("tr"), (-x["config"]).alias("first"), F.struct(x["te"].alias("te"), x["config"].alias("config")).alias("at"))))["at"]
    picked = scored.withColumn("winner", winner)
    place = F.size(F.filter("scores", lambda x: F.struct(x["te"].alias("te"), x["config"].alias("config")) <= F.col("winner")))
    return picked.groupBy("symbol", "family").agg(F.avg(F.when(place / (F.col("configs") + 1) <= 0.5, 1.0).otherwise(0.0)).alias("pbo"))


def _judged(scored: DataFrame, name: str) -> DataFrame:
    """Splits' winners by training score, averaged: (symbol, family, {name}_is, {name}_oos, {name}_consistency, {name}_efficiency)."""
    best = scored.groupBy("symbol", "family", "k").agg(F.max_by(F.struct("tr", "te"), _first_best("tr")).alias("b"))
    out = best.groupBy("symbol", "family").agg(
        F.avg("b.tr").alias(f"{name}_is"), F.avg("b.te").alias(f"{name}_oos"), F.avg(F.when(F.col("b.te") > 0, 1.0).otherwise(0.0)).alias(f"{name}_consistency")
    )
    return out.withColumn(f"{name}_efficiency", F.when(F.col(f"{name}_is") > 0, F.col(f"{name}_oos") / F.col(f"{name}_is")))


def walk_forward(rows: DataFrame) -> DataFrame:
    """Expanding windows: trained on all segments before each of the last WALKS, the last of which takes the rest."""
    segment = F.least(F.floor(F.col("i") / F.floor(F.col("n") / (WALKS + 1))), F.lit(WALKS)).cast("int")
    upto = Window.partitionBy("symbol", "family", "config").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = _sums(rows.withColumn("g", segment), "symbol", "family", "config", "g").withColumns({f"b{x}": F.sum(x).over(upto) for x in "csq"})
    scored = sums.where("g > 0").select("symbol", "family", "config", F.col("g").alias("k"), (sharpe_of(*(F.col(f"b{x}") for x in "csq")) * ROOT).alias("tr"), (sharpe_of(*(F.col(x) for x in "csq")) * ROOT).alias("te"))
    return _judged(scored, "walk")


def embargoes(families: dict[str, list[Params]]) -> dict[str, int]:
    """Per family, its longest whole-number parameter, two at least."""
    return {f: max([LEAST_EMBARGO, *(v for p in configs for v in p.values() if isinstance(v, int) and not isinstance(v, bool))]) for f, configs in families.items()}


def purged_folds(rows: DataFrame, embargo: dict[str, int]) -> DataFrame:
    """Contiguous folds, trained on what is farther than the family's embargo from the fold; folds without training rows go.

    A row belongs to one of at most 3 FOLDS segments (a fold's own rows, and the rows within an embargo before or after a
    fold's edges), whose sums are combined: the rows are never multiplied by the folds.
    """
    spark = rows.sparkSession
    sized = rows.join(F.broadcast(spark.createDataFrame(sorted(embargo.items()), "family string, embargo int")), "family")
    start = lambda k: F.floor(F.lit(k) * F.col("n") / FOLDS)
    inside = [((F.col("i") >= start(k)) & (F.col("i") < start(k + 1))) for k in range(FOLDS)]
    train = [((F.col("i") < start(k) - F.col("embargo")) | (F.col("i") >= start(k + 1) + F.col("embargo"))) for k in range(FOLDS)]
    marked = sized.withColumns({"own": F.concat(*[F.when(x, str(k)).otherwise("") for k, x in enumerate(inside)]), "far": F.concat(*[F.when(x, str(k)).otherwise("") for k, x in enumerate(train)])})
    sums = _sums(marked, "symbol", "family", "config", "own", "far")
    dealt = sums.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)])))  # a few sums by the folds
    side = lambda x, column: F.sum(F.when(F.col(column).contains(F.col("k").cast("string")), F.col(x)).otherwise(0))
    scored = dealt.groupBy("symbol", "family", "config", "k").agg(
        side("c", "far").alias("train"), (sharpe_of(*(side(x, "far") for x in "csq")) * ROOT).alias("tr"), (sharpe_of(*(side(x, "own") for x in "csq")) * ROOT).alias("te")
    )
    return _judged(scored.where("train > 0"), "purged")


def validated(rows: DataFrame, families: dict[str, list[Params]], embargo: dict[str, int] | None = None) -> DataFrame:
    """The validation report of each symbol and family: best candidate, margin, overfitting, stability, walk-forward, purged folds."""
    trials = _moments(rows)
    haircuts = {f: expected_max_sharpe(1.0, len(c)) for f, c in families.items()}
    price = F.create_map(*[x for f, h in haircuts.items() for x in (F.lit(f), F.lit(h))])
    best = trials.groupBy("symbol", "family").agg(
        F.max_by(F.struct("config", "sharpe", "n", "skew", "kurtosis", "since", "until"), _first_best("sharpe")).alias("best"), F.count("*").alias("n_configs"),
        F.stddev_samp("sharpe").alias("sd"), F.avg("sharpe").alias("mean"), F.collect_list("sharpe").alias("sharpes"),
    )
    report = best.select(
        "symbol", "family", "best.*", "n_configs", "sharpes", (F.col("best.sharpe") - F.greatest(F.greatest("sd", F.lit(1e-6)) * price[F.col("family")], F.lit(0.0))).alias("margin"),
        (1 / (1 + F.col("sd") / (F.abs("mean") + 1e-9))).alias("stability"),
    )
    return report.join(overfitting(rows), ["symbol", "family"]).join(walk_forward(rows), ["symbol", "family"]).join(purged_folds(rows, embargo or embargoes(families)), ["symbol", "family"], "left")


@F.pandas_udf(DoubleType())
def _probability(sharpe: pd.Series, bar: pd.Series, n: pd.Series, skew: pd.Series, kurtosis: pd.Series) -> pd.Series:
    """Deflated probability of per-bar ratios; null where it cannot be measured."""

    def one(*x: float) -> float | None:
        try:
            return None if any(pd.isna(v) for v in x) else probabilistic_sharpe(*x)
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(sharpe, bar, n, skew, kurtosis, strict=True)], dtype="float64")


def repriced(reports: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """``reports`` with the margin of the whole search, its probability, and trials, the lifetime count of candidates.

    The dispersion is that of all candidates of the symbol (a quarter range by 1.34898 from four on); ``prior(symbol, trials)``
    are the candidates of earlier searches.
    """
    key = Window.partitionBy("symbol")
    every = F.flatten(F.collect_list("sharpes").over(key))
    counted = reports.withColumn("all", F.array_sort(every))
    if prior is not None:
        counted = counted.join(prior.withColumnRenamed("trials", "prior"), "symbol", "left")
    counted = counted.withColumn("trials", F.size("all") + (F.coalesce("prior", F.lit(0)) if prior is not None else 0))
    m = F.size("all")
    at = lambda p: (m - 1) * p
    item = lambda k: F.get("all", k.cast("int"))
    quantile = lambda p: item(F.floor(at(p))) + (item(F.ceil(at(p))) - item(F.floor(at(p)))) * (at(p) - F.floor(at(p)))
    mean = F.aggregate("all", F.lit(0.0), lambda a, x: a + x) / m
    plain = F.sqrt(F.aggregate("all", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (m - 1))
    counted = counted.withColumn("dispersion", F.greatest(F.when(m < 4, plain).otherwise((quantile(0.75) - quantile(0.25)) / 1.34898), F.lit(1e-6)))
    haircut = F.col("dispersion") * _expected_max("trials")
    counted = counted.withColumn("margin", F.col("sharpe") - F.greatest(haircut, F.lit(0.0)))
    return counted.withColumn("probability", _probability(F.col("sharpe") / ROOT, haircut / ROOT, F.col("n").cast("double"), "skew", "kurtosis")).drop("all", "sharpes")


@F.pandas_udf(DoubleType())
def _expected_max(trials: pd.Series) -> pd.Series:
    return trials.map({n: expected_max_sharpe(1.0, int(n)) for n in trials.unique()}).astype("float64")  # few different counts


def gated(finalists: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``finalists`` plus the six verdicts, passed and the reasons against."""
    years = F.datediff("until", "since") / 365.25
    needed = F.when(F.col("sharpe") > 0, 2 * F.log("trials") / (F.col("sharpe") * F.col("sharpe")))  # null: no length would do
    tests = {
        "dsr_ok": F.col("margin") > gate.margin, "pbo_ok": F.col("pbo") < gate.pbo, "stability_ok": F.col("stability") >= gate.stability,
        "mintrl_ok": F.coalesce(years >= needed, F.lit(False)), "holdout_ok": F.col("holdout_sharpe") > gate.holdout,
        "beats_held_ok": (F.col("holdout_sharpe") > F.col("held_sharpe")) | F.lit(not gate.beat_holding),
    }
    judged = finalists.withColumns({**tests, "required_years": needed})
    reasons = F.array_compact(F.array(*[F.when(~F.col(t), t.removesuffix("_ok")) for t in tests]))
    return judged.withColumn("passed", reduce(Column.__and__, [F.col(t) for t in tests])).withColumn("reasons", reasons)


def coarse(names: Iterable[str] = tuple(CATALOG), budget: int = Gate.budget, per_parameter: int = 3, *, refine: bool = True) -> tuple[dict[str, list[Params]], int]:
    """Candidates of each family within the budget, and what is reserved for the refinement (its quota comes last)."""
    grids = {name: found for name in names if len(found := grid.grid(name, per_parameter)) >= LEAST_CONFIGS}
    largest = max((per_parameter ** len(CATALOG[name][1]) for name in grids), default=0)
    sizes = {name: len(g) for name, g in grids.items()} | ({"~refined": largest} if refine else {})
    quota = allocate(sizes, budget)
    return {name: space_filling(grids[name], quota[name]) for name in grids}, quota.get("~refined", 0)


def _holdout(rest: DataFrame, winners: DataFrame, families: dict[str, list[Params]]) -> DataFrame:
    """(symbol, holdout_sharpe, holdout_return, holdout_bars, held_sharpe): each symbol's winner alone, on bars that no search saw."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    own = returns(rest, families).join(winners.select("symbol", "family", "config"), ["symbol", "family", "config"])
    sharpe = lambda x: F.coalesce(F.when(F.stddev_samp(x) > 1e-12, F.avg(x) / F.stddev_samp(x)), F.lit(0.0)) * ROOT
    return own.withColumn("equity", F.product(1 + F.col("net")).over(w)).groupBy("symbol").agg(
        sharpe("net").alias("holdout_sharpe"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("holdout_return"), F.count("*").alias("holdout_bars"), sharpe("ret").alias("held_sharpe")
    )


def search(bars: DataFrame, names: Iterable[str] = tuple(CATALOG), gate: Gate = Gate(), *, refine: bool = True, prior: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(trials, verdicts): each family's best candidate with its report, and the gated finalist of each symbol.

    ``keep`` writes and rereads (or checkpoints) what is used again. The refinement goes a quarter around each symbol's coarse winner;
    the distinct winners, at most as many as there are candidates, come to the driver to make the grids.
    """
    parts = keep(split(bars))
    head, rest = parts.where("part = 'head'"), parts.where("part = 'holdout'")
    families, reserve = coarse(names, gate.budget, refine=refine)
    reports = keep(validated(returns(head, families, keep), families).withColumn("stage", F.lit("coarse")))
    everything = dict(families)
    if refine and reserve >= LEAST_CONFIGS:
        top = Window.partitionBy("symbol").orderBy(F.desc(F.round("sharpe", 12)), "family")
        winners = keep(reports.withColumn("place", F.row_number().over(top)).where("place = 1").select("symbol", "family", "config"))
        zooms = {}
        for r in winners.select("family", "config").distinct().orderBy("family", "config").collect():
            near = space_filling(grid.refine(r["family"], families[r["family"]][r["config"]]), reserve)
            if len(near) >= LEAST_CONFIGS:
                zooms[r["family"], r["config"]] = near
        for (family, config), near in zooms.items():
            own = winners.where((F.col("family") == family) & (F.col("config") == config)).select("symbol")
            base = len(everything[family])
            everything[family] = [*everything[family], *near]
            again = validated(returns(head.join(own, "symbol", "left_semi"), {family: near}, keep), {family: near})
            reports = reports.unionByName(again.withColumns({"config": F.col("config") + base, "stage": F.lit("refined")}))
    trials = keep(repriced(reports, prior))
    top = Window.partitionBy("symbol").orderBy(F.desc(F.round("sharpe", 12)), F.col("stage"), "family")
    finalists = keep(trials.withColumn("place", F.row_number().over(top)).where("place = 1").drop("place"))
    used = {(r["family"], r["config"]) for r in finalists.select("family", "config").distinct().collect()}
    picked = {f: sorted(c for g, c in used if g == f) for f in {f for f, _ in used}}
    number = F.create_map(*[x for f, cs in picked.items() for k, c in enumerate(cs) for x in (F.lit(f"{f}/{c}"), F.lit(k))]) if used else F.create_map()
    winners = finalists.select("symbol", "family", number[F.concat_ws("/", "family", F.col("config").cast("string"))].alias("config"))
    scored = _holdout(rest, winners, {f: [everything[f][c] for c in cs] for f, cs in picked.items()}) if used else None
    if scored is None:
        return trials, finalists
    return trials, gated(finalists.join(scored, "symbol"), gate)


#: The registered searches: trials of the whole catalog, verdicts of a few families (a fold among them) with refinement.
BUDGET = Gate(budget=72)
FEW = ("bollinger_bands", "donchian_atr_trail", "donchian_breakout", "mean_reversion", "momentum", "sma")
FEW_BUDGET = Gate(budget=20)


def _kept(df: DataFrame) -> DataFrame:
    """Cut by a checkpoint where the session has a folder for it, else cached."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return search(ALL_BARS.frame(spark, sf_dir), FEW, FEW_BUDGET, keep=_kept)


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moments(returns(split(ALL_BARS.frame(spark, sf_dir)).where("part = 'head'"), coarse(budget=BUDGET.budget)[0]))


def finalists(trials: DataFrame) -> DataFrame:
    """The best candidate of each symbol with its margin over the symbol's candidates, and whether it clears the null's bar."""
    best = trials.groupBy("symbol").agg(
        F.min_by(F.struct("family", "config", "sharpe", "n"), F.struct((-F.round("sharpe", 12)).alias("a"), "family", "config")).alias("best"), F.stddev_samp("sharpe").alias("sd"), F.count("*").alias("trials")
    )
    haircut = F.greatest(F.col("sd") * _expected_max("trials"), F.lit(0.0))
    return best.select("symbol", "best.*", "trials", haircut.alias("haircut")).withColumns({
        "margin": F.col("sharpe") - F.col("haircut"), "clears_bar": F.col("sharpe") > F.sqrt(2 * F.log("trials")) / F.sqrt(F.col("n") / YEAR),
    }).drop("haircut")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    config = lambda: F.col("config").cast("long").alias("config")
    return {
        "search_candidates": lambda s, d: planned(split(ALL_BARS.frame(s, d)).where("part = 'head'"), coarse(budget=BUDGET.budget)[0]),
        "search_trials": lambda s, d: _trials(s, d).select("symbol", "family", config(), "n", *six("sharpe")),
        "search_finalists": lambda s, d: finalists(_trials(s, d)).select("symbol", "family", config(), *six("sharpe", "margin"), "clears_bar"),
        "search_reports": lambda s, d: _run(s, d)[0].select("symbol", "family", "stage", config(), F.col("trials").cast("long").alias("trials"),
            *six("sharpe", "margin", "probability", "pbo", "stability", "walk_oos", "purged_oos")),
        "search_verdicts": lambda s, d: _run(s, d)[1].select("symbol", "family", "stage", "passed", F.array_join("reasons", ",").alias("reasons"), *six("sharpe", "margin", "holdout_sharpe", "held_sharpe", "holdout_return")),
    }


def planned(head: DataFrame, families: dict[str, list[Params]]) -> DataFrame:
    """(symbol, n, family, config, params): what the search of each symbol will try, and on how many bars."""
    listed = [F.struct(F.lit(f).alias("family"), F.lit(k).cast("long").alias("config"), F.lit(canonical(p)).alias("params")) for f, configs in families.items() for k, p in enumerate(configs)]
    return head.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", "n", F.explode(F.array(*listed)).alias("c")).select("symbol", "n", "c.*")


def _listed() -> list[tuple[str, int, str]]:
    return [(f, k, canonical(p)) for f, configs in coarse(budget=BUDGET.budget)[0].items() for k, p in enumerate(configs)]


def oracle_sql() -> dict[str, str]:
    """Every candidate by itself, each in a query of its own, over the head of the bars."""
    families, _ = coarse(budget=BUDGET.budget)
    tail = f"greatest(CAST(floor({HOLDOUT} * n) AS BIGINT), {HOLDOUT_ROWS})"
    head_base = Base(ALL_BARS.frame, "head")
    sharpe = f"coalesce(CASE WHEN stddev_samp(net) > 1e-12 THEN {ROOT!r} * avg(net) / stddev_samp(net) END, 0.0)"
    parts = [
        f"SELECT symbol, '{family}' AS family, CAST({k} AS BIGINT) AS config, count(*) AS n, {sharpe} AS sharpe FROM {run(family, head_base, **p).sql} GROUP BY symbol"
        for family, configs in families.items() for k, p in enumerate(configs)
    ]
    head = f"""WITH head AS MATERIALIZED (SELECT symbol, ts, open, high, low, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM {ALL_BARS.sql})
        WHERE n - {tail} >= {HEAD_ROWS} AND i < n - {tail}) """
    base = head.rstrip() + f""", trials AS MATERIALIZED ({" UNION ALL ".join(parts)}) """
    values = ", ".join(f"('{f}', CAST({k} AS BIGINT), '{c}')" for f, k, c in _listed())
    return {
        "search_candidates": head + f"SELECT symbol, n, family, config, params FROM (SELECT symbol, count(*) AS n FROM head GROUP BY symbol), (VALUES {values}) g(family, config, params)",
        "search_trials": base + "SELECT symbol, family, config, n, round(sharpe, 6) AS sharpe FROM trials",
        "search_finalists": base + f"""SELECT symbol, family, config, round(sharpe, 6) AS sharpe, round(sharpe - greatest(sd * {expected_max_sharpe(1.0, len(parts))!r}, 0.0), 6) AS margin, sharpe > sqrt(2 * ln(trials)) / sqrt(n / {YEAR}.0) AS clears_bar
            FROM (SELECT *, row_number() OVER w AS place, stddev_samp(sharpe) OVER (PARTITION BY symbol) AS sd, count(*) OVER (PARTITION BY symbol) AS trials FROM trials WINDOW w AS (PARTITION BY symbol ORDER BY round(sharpe, 12) DESC, family, config)) WHERE place = 1""",
    }
