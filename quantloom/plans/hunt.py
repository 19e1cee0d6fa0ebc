"""A search over a whole universe: screened before anything is read, with a recorded outcome for every symbol.

Nothing is raised for a symbol. What a screen refuses is ``filtered`` before its bars are read (the screened
symbols prune a store that is partitioned by symbol); what cannot be searched is ``failed``, with the reason; the rest is ``searched``
in one pass. A symbol graduates if the gate passes it and neither its fundamentals nor distress veto it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import fundamentals, pool
from quantloom.operators.grid import CATALOG, parameter_hash
from quantloom.operators.kernel import YEAR
from quantloom.plans import search
from quantloom.plans.search import Gate
from quantloom.sources import edgar
from quantloom.sources.bars import ohlcv, table

#: Symbols that may be broadcast (some 50 MB); more are joined by a shuffle.
BROADCAST_SYMBOLS = 1_000_000
Screen = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Screens:
    """What is known of companies: ``records(symbol, value, quality, ...)`` with the screens to apply in order, and the two vetoes.

    ``fundamentals(symbol, passed, reasons)`` and ``distress(symbol, distressed, reasons)`` veto graduation; a symbol
    that they do not know is not vetoed. Records without screens are only recorded.
    """

    records: DataFrame | None = None
    screens: tuple[Screen, ...] = ()
    fundamentals: DataFrame | None = None
    distress: DataFrame | None = None


@dataclass(frozen=True)
class Hunt:
    outcomes: DataFrame
    trials: DataFrame
    verdicts: DataFrame


def sized(symbols: DataFrame) -> DataFrame:
    """With a broadcast hint, if there are few enough."""
    return F.broadcast(symbols) if symbols.limit(BROADCAST_SYMBOLS + 1).count() <= BROADCAST_SYMBOLS else symbols


def screened(universe: DataFrame, known: Screens = Screens()) -> DataFrame:
    """(symbol, value, filtered): each symbol once; filtered are the reasons of the first screen that refuses it, null if none does."""
    rows = universe.select("symbol").where("symbol IS NOT NULL").distinct()
    if known.records is None:
        return rows.select("symbol", F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("filtered"))
    rows = rows.join(known.records, "symbol", "left").withColumn("filtered", F.lit(None).cast("string"))
    for screen in known.screens:
        judged = screen(rows.withColumnRenamed("filtered", "before"))
        refused = F.when(~F.col("passed"), F.array_join("reasons", "; "))
        rows = judged.withColumn("filtered", F.coalesce("before", refused)).drop("before", "passed", "reasons")
    return rows.select("symbol", "value", "filtered")


def wanted(marked: DataFrame) -> DataFrame:
    """What no screen refuses; a comparison, which the optimizer takes for selective enough to prune partitions by."""
    return marked.where(F.coalesce("filtered", F.lit("")) == "")


def bars_of(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """The bars of ``symbols(symbol)`` alone: a store that is partitioned by symbol is read in those partitions only."""
    return bars.join(sized(symbols.select("symbol")), "symbol", "left_semi")


def outcomes(marked: DataFrame, bars: DataFrame, n_families: int) -> DataFrame:
    """(symbol, outcome, reason, value, n_bars) for every row of ``screened``, from one count of the bars by symbol."""
    usable = F.coalesce((F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < float("inf")), F.lit(False))
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(~usable).alias("bad"), F.countDistinct("ts").alias("days"))
    head = F.col("n") - F.greatest(F.floor(F.col("n") * search.HOLDOUT), F.lit(search.HOLDOUT_ROWS))
    failed = (
        F.when(F.col("n").isNull(), "no bars")
        .when(F.col("bad") > 0, F.format_string("%d bars without a positive close", "bad"))
        .when(F.col("days") < F.col("n"), F.format_string("%d bars of a time that has another", F.col("n") - F.col("days")))
        .when(head < search.HEAD_ROWS, F.format_string(f"%d bars before the holdout, {search.HEAD_ROWS} are needed", F.greatest(head, F.lit(0))))
        .when(F.lit(n_families == 0), "no valid strategies")
    )
    joined = marked.join(counts, "symbol", "left").withColumn("failed", F.when(F.col("filtered").isNull(), failed))
    outcome = F.when(F.col("filtered").isNotNull(), "filtered").when(F.col("failed").isNotNull(), "failed").otherwise("searched")
    return joined.select("symbol", outcome.alias("outcome"), F.coalesce("filtered", "failed").alias("reason"), "value", F.when(F.col("filtered").isNull(), F.coalesce("n", F.lit(0))).alias("n_bars"))


def vetoed(verdicts: DataFrame, known: Screens) -> DataFrame:
    """``verdicts`` plus vetoes (what speaks against the company) and graduated."""
    vetoes = []
    if known.fundamentals is not None:
        screen = known.fundamentals.select("symbol", (~F.col("passed")).alias("unsound"))
        verdicts, vetoes = verdicts.join(screen, "symbol", "left"), [F.when(F.col("unsound"), "fundamentals")]
    if known.distress is not None:
        verdicts = verdicts.join(known.distress.select("symbol", "distressed"), "symbol", "left")
        vetoes = [*vetoes, F.when(F.col("distressed"), "distress")]
    found = F.array_compact(F.array(*vetoes)) if vetoes else F.array().cast("array<string>")
    verdicts = verdicts.withColumn("vetoes", found)
    return verdicts.withColumn("graduated", F.col("passed") & (F.size("vetoes") == 0)).drop("unsound", "distressed")


def version(names: Iterable[str], gate: Gate, *, refine: bool) -> str:
    """What was searched, so that records of different searches are told apart."""
    return parameter_hash({"families": sorted(names), "gate": gate.version, "refine": refine})


def hunt(
    universe: DataFrame, bars: DataFrame, names: Iterable[str] = tuple(CATALOG), gate: Gate = Gate(), known: Screens = Screens(), *,
    refine: bool = False, experiments: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> Hunt:
    """Outcomes of every symbol of ``universe(symbol)``, the trials of those that could be searched, and their verdicts.

    ``experiments(symbol, lifetime_trials)`` are the pool's records, whose candidates count as tried. Verdicts carry vetoes, graduated,
    value, n_bars, lifetime_trials and the search's version: a row is an experiment of the pool.
    """
    names = tuple(names)
    families, _ = search.coarse(names, gate.budget, refine=refine)
    marked = keep(screened(universe, known))
    read = bars_of(bars, wanted(marked))
    found = keep(outcomes(marked, read, len(families)))
    searched = found.where("outcome = 'searched'")
    prior = None if experiments is None else pool.prior_trials(experiments)
    trials, verdicts = search.search(bars_of(bars, searched), names, gate, refine=refine, prior=prior, keep=keep)
    rows = vetoed(verdicts, known).join(searched.select("symbol", "value", "n_bars"), "symbol")
    return Hunt(found, trials, rows.withColumnsRenamed({"trials": "lifetime_trials"}).withColumn("version", F.lit(version(names, gate, refine=refine))))


def yield_rate(found: DataFrame) -> DataFrame:
    """One row: symbols attempted, searched, failed and filtered, and the share of the attempted that were searched (1 of none)."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    tried = n("searched") + n("failed")
    return found.agg(tried.alias("attempted"), n("searched").alias("searched"), n("failed").alias("failed"), n("filtered").alias("filtered"), F.when(tried == 0, 1.0).otherwise(n("searched") / tried).alias("rate"))


def ranked(verdicts: DataFrame) -> DataFrame:
    """The hunt's leaderboard: graduates first, then by margin; whether a graduate clears the bar of the best among so many without skill."""
    size = F.broadcast(verdicts.agg(F.countDistinct("symbol").alias("n_symbols")))
    bar = pool.null_bar(F.col("n_symbols"), F.col("holdout_bars") / YEAR)
    rows = verdicts.crossJoin(size).withColumn("survives", F.when(F.col("graduated"), F.col("holdout_sharpe") > bar))
    return rows.orderBy(F.desc("graduated"), F.desc(F.round("margin", 12)), "symbol").select(
        "symbol", "family", "margin", "graduated", F.when(F.col("graduated"), F.col("holdout_sharpe")).alias("holdout_sharpe"), "survives", "value"
    )


def promoted(verdicts: DataFrame, earlier: DataFrame, book: DataFrame) -> DataFrame:
    """(symbol, family) that open now: graduates of this hunt and of the pool's ``earlier(symbol, family, graduated)`` that ``book(symbol, family)`` never held."""
    graduates = verdicts.where("graduated").select("symbol", "family").unionByName(earlier.where("graduated").select("symbol", "family")).distinct()
    return pool.newly_promoted(book, graduates)


def hunt_and_promote(universe: DataFrame, bars: DataFrame, names: Iterable[str], gate: Gate, known: Screens, earlier: DataFrame, book: DataFrame, **how: object) -> tuple[Hunt, DataFrame]:
    """The hunt, and the book after it: ``book(symbol, family, status)`` plus what is promoted as open. A second run changes nothing.

    ``earlier(symbol, family, graduated, lifetime_trials)`` is the pool; its trials count as tried.
    """
    done = hunt(universe, bars, names, gate, known, experiments=earlier, **how)
    opened = promoted(done.verdicts, earlier, book).withColumns({"status": F.lit("open"), "promoted": F.lit(True)})
    return done, book.withColumn("promoted", F.lit(False)).unionByName(opened.select("symbol", "family", "status", "promoted"))


# The driver's suppliers as companies: bars of their line items, filings and prices as in fundamentals; nations have no bars.

_SUPPLIER = "format_string('S%06d', l_suppkey)"
LEAST_VALUE, LEAST_QUALITY = 0.3, 0.4


def _universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.format_string("N%02d", F.col("n_nationkey").cast("int")).alias("symbol"))
    return table(spark, sf_dir, "supplier").select(F.format_string("S%06d", F.col("s_suppkey").cast("long")).alias("symbol")).unionByName(nations)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(table(spark, sf_dir, "lineitem"), _SUPPLIER, "100 + l_extendedprice / 100000.0")


def _known(spark: SparkSession, sf_dir: str) -> Screens:
    history = search._kept(fundamentals._history(spark, sf_dir))
    prices = search._kept(fundamentals.closes(spark, sf_dir))
    last = prices.groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))
    screens = (lambda df: fundamentals.screen_value(df, LEAST_VALUE), lambda df: fundamentals.screen_quality(df, LEAST_QUALITY))
    return Screens(
        fundamentals.records(fundamentals.attach_prices(history, prices), last), screens,
        fundamentals.screen_fundamentals(edgar.snapshot(fundamentals.filings(spark, sf_dir)), growth=None),
        fundamentals.distress(fundamentals.latest_pairs(history)),
    )


def _hunted(spark: SparkSession, sf_dir: str) -> Hunt:
    return hunt(_universe(spark, sf_dir), _bars(spark, sf_dir), search.FEW, search.FEW_BUDGET, _known(spark, sf_dir), keep=search._kept)


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes alone, without the search."""
    marked = search._kept(screened(_universe(spark, sf_dir), _known(spark, sf_dir)))
    return outcomes(marked, bars_of(_bars(spark, sf_dir), wanted(marked)), len(search.FEW))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    return {
        "hunt_outcomes": lambda s, d: _outcomes(s, d).select("symbol", "outcome", "reason", "n_bars", *six("value")),
        "hunt_yield": lambda s, d: yield_rate(_outcomes(s, d)).select("attempted", "searched", "failed", "filtered", *six("rate")),
        "hunt_verdicts": lambda s, d: _hunted(s, d).verdicts.select("symbol", "family", "passed", "graduated", F.array_join("reasons", ",").alias("reasons"), F.array_join("vetoes", ",").alias("vetoes"),
            F.col("lifetime_trials").cast("long").alias("lifetime_trials"), "n_bars", "version", *six("margin", "holdout_sharpe", "held_sharpe", "value")),
        "hunt_leaderboard": lambda s, d: ranked(_hunted(s, d).verdicts).select("symbol", "family", "graduated", "survives", *six("margin", "holdout_sharpe", "value")),
    }


def oracle_sql() -> dict[str, str]:
    """Outcomes by SQL of their own: records, screens, bars and lengths."""
    tail = f"greatest(CAST(floor({search.HOLDOUT} * n) AS BIGINT), {search.HOLDOUT_ROWS})"
    outcome = fundamentals.base_sql() + f""",
        u AS (SELECT 'S' || lpad(s_suppkey::VARCHAR, 6, '0') AS symbol FROM supplier UNION SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') FROM nation),
        b AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, count(DISTINCT CAST(l_shipdate AS DATE)) AS n FROM lineitem GROUP BY 1),
        o AS (SELECT u.symbol, r.value, CASE WHEN r.value < {LEAST_VALUE} THEN 'not cheap enough' WHEN r.quality IS NOT NULL AND r.quality < {LEAST_QUALITY} THEN 'quality too low' END AS filtered,
            CASE WHEN n IS NULL THEN 'no bars' WHEN n - {tail} < {search.HEAD_ROWS} THEN greatest(n - {tail}, 0) || ' bars before the holdout, {search.HEAD_ROWS} are needed' END AS failed, coalesce(n, 0) AS n
            FROM u LEFT JOIN r USING (symbol) LEFT JOIN b USING (symbol)),
        x AS (SELECT symbol, CASE WHEN filtered IS NOT NULL THEN 'filtered' WHEN failed IS NOT NULL THEN 'failed' ELSE 'searched' END AS outcome, coalesce(filtered, failed) AS reason,
            CASE WHEN filtered IS NULL THEN CAST(n AS BIGINT) END AS n_bars, round(value, 6) AS value FROM o)
        """
    return {
        "hunt_outcomes": outcome + "SELECT symbol, outcome, reason, n_bars, value FROM x",
        "hunt_yield": outcome + """SELECT count(*) FILTER (outcome <> 'filtered') AS attempted, count(*) FILTER (outcome = 'searched') AS searched, count(*) FILTER (outcome = 'failed') AS failed,
            count(*) FILTER (outcome = 'filtered') AS filtered, round(CASE WHEN count(*) FILTER (outcome <> 'filtered') = 0 THEN 1.0 ELSE count(*) FILTER (outcome = 'searched') / count(*) FILTER (outcome <> 'filtered') END, 6) AS rate FROM x""",
    }
