"""Factors over a universe: a hunt that records every symbol, and a forward book of versions.

A book row is a version of a position: it holds from ``valid_from`` until ``valid_to`` (null: still). A step of the book ends the version
of an open position whose verdict or score has changed, and begins the next; rows that have ended, and positions that are retired, are never
touched again, so that the book is a record of what was known when. The same step twice is one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.factors import MIN_BARS, PANEL
from quantloom.operators.grid import Params, canonical
from quantloom.plans import panel_search, search
from quantloom.plans.panel_search import FACTORS, LEAST_SHARPE, lifecycle, returns
from quantloom.plans.search import Gate

LEAST_SYMBOLS = 2
BOOK = (
    "family string, universe string, params string, frozen_at date, status string, n long, sharpe double, held_sharpe double, drawdown double, "
    "reasons array<string>, retired_at date, valid_from date, valid_to date"
)
#: What makes two versions of a position differ.
_SEEN = ["status", "n", "sharpe", "held_sharpe", "drawdown", "reasons", "retired_at"]
_KEY = ["family", "universe"]


def panel_of(bars: DataFrame) -> DataFrame:
    """(symbol, ts, close): symbols of enough closes, on the dates that all of them have."""
    closed = bars.where((F.col("close") > 0) & ~F.isnan("close")).select("symbol", "ts", "close")
    long = closed.withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("n") >= MIN_BARS).drop("n")
    size = F.broadcast(long.agg(F.countDistinct("symbol").alias("n_symbols")))
    return long.withColumn("present", F.count("*").over(Window.partitionBy("ts"))).crossJoin(size).where("present = n_symbols").drop("present", "n_symbols")


def outcomes(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, outcome, reason): every symbol of the universe is in the panel, or why not."""
    counts = bars.groupBy("symbol").agg(F.count_if((F.col("close") > 0) & ~F.isnan("close")).alias("n"))
    known = universe.select("symbol").where("symbol IS NOT NULL").distinct().join(counts, "symbol", "left")
    reason = F.when(F.col("n").isNull(), "no bars").when(F.col("n") < MIN_BARS, F.format_string(f"%d closes, {MIN_BARS} are needed", "n"))
    return known.select("symbol", F.when(reason.isNull(), "panel").otherwise("failed").alias("outcome"), reason.alias("reason"))


def universe_of(panel: DataFrame) -> str:
    """What names a universe: the digest of its sorted symbols (made on the cluster)."""
    return panel.select("symbol").distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("symbol")), ","), 256)).first()[0]


@dataclass(frozen=True)
class FactorHunt:
    outcomes: DataFrame
    universe: str
    trials: DataFrame
    verdict: DataFrame


def hunt(universe: DataFrame, bars: DataFrame, gate: Gate = Gate(), names: tuple[str, ...] = tuple(FACTORS), *, prior: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> FactorHunt:
    """The search over the panel of what can be used; fewer than two such symbols cannot be ranked and are an error."""
    own = bars.join(universe.select("symbol").where("symbol IS NOT NULL").distinct(), "symbol", "left_semi")
    found = keep(outcomes(universe, own))
    usable = found.where("outcome = 'panel'").count()
    if usable < LEAST_SYMBOLS:
        raise ValueError(f"at least {LEAST_SYMBOLS} symbols with bars are needed to rank, there are {usable}")
    panel = keep(panel_of(own))
    trials, verdict = panel_search.run(panel, gate, names, prior, keep)
    families = panel_search.candidates(names, gate.budget)
    params = F.create_map(*[x for f, configs in families.items() for c, p in enumerate(configs) for x in (F.lit(f"{f}/{c}"), F.lit(canonical(p)))])
    named = verdict.withColumn("params", params[F.concat_ws("/", "family", F.col("config").cast("string"))]).withColumn("universe", F.lit(universe_of(panel)))
    return FactorHunt(found, universe_of(panel), trials, named)


def states(book: DataFrame, panel: DataFrame, universe: str) -> DataFrame:
    """(family, universe, n, sharpe, held_sharpe, drawdown, reasons, state) of the universe's open positions by what came after they were frozen.

    The book's open positions are read by the driver: one a factor. The factors are computed over all prices, then cut.
    """
    spark = panel.sparkSession
    rows = book.where((F.col("status") == "open") & F.col("valid_to").isNull() & (F.col("universe") == universe)).select("family", "params", "frozen_at").collect()
    families: dict[str, list[Params]] = {r["family"]: [json.loads(r["params"])] for r in rows}
    empty = "family string, n long, sharpe double, held_sharpe double, drawdown double, reasons array<string>, state string"
    if not rows:
        return spark.createDataFrame([], empty).withColumn("universe", F.lit(universe))
    since = F.broadcast(spark.createDataFrame([(r["family"], r["frozen_at"]) for r in rows], "family string, frozen_at date"))
    after = returns(panel, families).join(since, "family").where(F.col("ts") > F.col("frozen_at"))
    judged = lifecycle(after).drop("config")
    none = since.select("family").join(judged, "family", "left_anti").select(
        "family", F.lit(0).cast("long").alias("n"), F.lit(LEAST_SHARPE).alias("sharpe"), F.lit(0.0).alias("held_sharpe"), F.lit(0.0).alias("drawdown"), F.array(F.lit("grace")).alias("reasons"), F.lit("hold").alias("state")
    )
    return judged.unionByName(none).withColumn("universe", F.lit(universe))


def step(book: DataFrame, graduates: DataFrame, judged: DataFrame, now: str) -> DataFrame:
    """The book after a day: ``graduates(family, universe, params)`` that it never held open, open positions take ``judged``'s score or retire."""
    today = F.lit(now).cast("date")
    live = (F.col("status") == "open") & F.col("valid_to").isNull()
    past, current = book.where(~live), book.where(live)
    verdict = judged.select(*_KEY, *[F.col(c).alias(f"new_{c}") for c in ("n", "sharpe", "held_sharpe", "drawdown", "reasons", "state")])
    both = current.join(verdict, _KEY, "left")
    retires = F.col("new_state") == "retire"
    seen = {
        "status": F.when(retires, "retired").otherwise("open"), "retired_at": F.when(retires, today),
        **{c: F.coalesce(f"new_{c}", c) for c in ("n", "sharpe", "held_sharpe", "drawdown", "reasons")},
    }
    same = F.lit(True)
    for c in _SEEN:
        same = same & F.col(c).eqNullSafe(seen[c])
    both = both.withColumns({"same": F.col("new_state").isNull() | same, "at_once": F.col("valid_from") == today, **{f"next_{c}": x for c, x in seen.items()}})
    kept = both.where("same").select(*book.columns)
    ended = both.where("NOT same AND NOT at_once").withColumn("valid_to", today).select(*book.columns)
    begun = both.where("NOT same").select(*[F.col(f"next_{c}").alias(c) if c in _SEEN else today.alias(c) if c == "valid_from" else F.col(c) for c in book.columns])
    fresh = graduates.select(*_KEY, "params").groupBy(*_KEY).agg(F.min("params").alias("params")).join(book.select(*_KEY).distinct(), _KEY, "left_anti")
    blank = {c: F.lit(None).cast(t) for c, t in book.dtypes if c in ("retired_at", "valid_to", "sharpe", "held_sharpe", "drawdown")}
    opened = fresh.withColumns({"frozen_at": today, "status": F.lit("open"), "n": F.lit(0).cast("long"), "reasons": F.array().cast("array<string>"), "valid_from": today, **blank}).select(*book.columns)
    return past.unionByName(kept).unionByName(ended).unionByName(begun).unionByName(opened)


def current(book: DataFrame) -> DataFrame:
    return book.where("valid_to IS NULL")


def as_of(book: DataFrame, day: str) -> DataFrame:
    """The versions that held on a day."""
    at = F.lit(day).cast("date")
    return book.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


# The registered book: every factor's first candidate is frozen on a day, and judged on two later ones.

FROZEN, DAYS = "1998-06-30", ("1999-06-30", "2001-12-31")


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = search._kept(PANEL.frame(spark, sf_dir))
    universe = universe_of(panel)
    first = {f: configs[0] for f, configs in panel_search.candidates(budget=panel_search.BUDGET.budget).items()}
    graduates = spark.createDataFrame([(f, universe, canonical(p)) for f, p in first.items()], "family string, universe string, params string")
    book = step(spark.createDataFrame([], BOOK), graduates, states(spark.createDataFrame([], BOOK), panel, universe), FROZEN)
    for day in DAYS:
        book = search._kept(book)
        book = step(book, graduates, states(book, panel.where(F.col("ts") <= F.lit(day).cast("date")), universe), day)
    return book


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    days = lambda: [F.col(c).cast("string").alias(c) for c in ("frozen_at", "retired_at", "valid_from", "valid_to")]
    return {"xs_book": lambda s, d: _book(s, d).select("family", "status", F.array_join("reasons", ",").alias("reasons"), F.coalesce("n", F.lit(0)).alias("n"), *days(), *six("sharpe", "held_sharpe", "drawdown"))}
