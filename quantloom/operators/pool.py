"""The research pool: retention, merging, leaderboard, deflation, near misses, cohorts, promotion, yield.

``experiments(experiment_id, symbol, created, version, lifetime_trials, n_bars, graduated, holdout_sharpe, holdout_bars)`` is one
row a search, ``trials(experiment_id, family, deflated, walk_oos)`` one a family's finalist. All is by symbol or by experiment;
what concerns the whole pool is a one-row aggregate that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators.statistics import SQUARED, quantile
from quantloom.sources import documents
from quantloom.sources.bars import table, tasks_of

YEAR = 252
RETAINED = 5


def null_bar(n_symbols: Column, years: Column) -> Column:
    """Best holdout Sharpe ratio that selection among so many symbols without skill is expected to show."""
    return F.when((n_symbols >= 2) & (years > 0), F.sqrt(1 / years) * F.sqrt(2 * F.log(n_symbols))).otherwise(0.0)


def retain_recent(experiments: DataFrame, keep: int = RETAINED) -> DataFrame:
    """All graduates, and of each symbol the newest others (ties by id)."""
    order = Window.partitionBy("symbol", "graduated").orderBy(F.desc("created"), F.desc("experiment_id"))
    return experiments.withColumn("_k", F.row_number().over(order)).where(F.col("graduated") | (F.col("_k") <= keep)).drop("_k")


def merged(pool: DataFrame, incoming: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Both, by id; of equal ids the incoming one."""
    return pool.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def prior_trials(experiments: DataFrame) -> DataFrame:
    """(symbol, trials): the candidates that a next search of the symbol has to count, the most that any record carries."""
    return experiments.groupBy("symbol").agg(F.max("lifetime_trials").alias("trials"))


def best_trials(trials: DataFrame) -> DataFrame:
    """(experiment_id, best): each experiment's trial with the greatest deflated ratio, of equals the first by family, then by walk_oos; nulls last."""
    order = [x for key in (-F.col("deflated"), F.col("family"), F.col("walk_oos")) for x in (key.isNull(), key)]
    return trials.groupBy("experiment_id").agg(F.min_by(F.struct("family", "deflated", "walk_oos"), F.struct(*[x.alias(f"k{i}") for i, x in enumerate(order)])).alias("best"))


def _with_bar(experiments: DataFrame) -> DataFrame:
    """``experiments`` plus years of holdout, bar, and survives (null for what has not graduated)."""
    size = F.broadcast(experiments.agg(F.countDistinct("symbol").alias("n_symbols")))
    known = experiments.crossJoin(size).withColumn("years", F.col("holdout_bars") / YEAR)
    known = known.withColumn("bar", null_bar(F.col("n_symbols"), F.col("years")))
    return known.withColumn("survives", F.when(F.col("graduated"), F.col("holdout_sharpe") > F.col("bar")))


def leaderboard(experiments: DataFrame, trials: DataFrame) -> DataFrame:
    """One row a symbol, its best experiment: graduates before others, then by deflated ratio (ties by id)."""
    rows = _with_bar(experiments).join(best_trials(trials), "experiment_id")
    row = F.struct(F.col("best.family").alias("family"), F.col("best.deflated").alias("deflated"), "graduated", F.when(F.col("graduated"), F.col("holdout_sharpe")).alias("holdout_sharpe"), "survives")
    order = F.struct(F.col("graduated").cast("int"), F.col("best.deflated"), -F.col("experiment_id"))
    return rows.groupBy("symbol").agg(F.max_by(row, order).alias("row")).select("symbol", "row.*")


def near_misses(experiments: DataFrame, trials: DataFrame, top: int = 10) -> DataFrame:
    """Graduates under the bar, each symbol and family by its best, the nearest to the bar first: a report of ``top`` rows."""
    rows = _with_bar(experiments).where("graduated AND bar > 0 AND NOT survives").join(best_trials(trials), "experiment_id")
    best = rows.groupBy("symbol", F.col("best.family").alias("family")).agg(F.max(F.col("holdout_sharpe") / F.col("bar")).alias("ratio"))
    return best.orderBy(F.desc(F.round("ratio", 9)), "symbol", "family").limit(top)


def _diagnostic(x: Column | str, name: str) -> list[Column]:
    """Median, number, 95th percentile and greatest of what is not null; without any, the number is 0 and the rest null."""
    return [F.median(x).alias(name), F.count(x).alias(f"{name}_n"), F.percentile(x, 0.95).alias(f"{name}_p95"), F.max(x).alias(f"{name}_max")]


def versions(experiments: DataFrame) -> DataFrame:
    """(version, n): how many experiments each family of hypotheses has, the most first."""
    return experiments.groupBy("version").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "version")


def summary(experiments: DataFrame, trials: DataFrame) -> DataFrame:
    """One row: the funnel from trials to symbols whose best survives, medians, and the diagnostics of finalists and graduates."""
    marked = _with_bar(experiments)
    board = F.broadcast(leaderboard(experiments, trials).agg(F.count_if("graduated").alias("n_leaderboard_graduates"), F.count_if(F.col("survives")).alias("n_surviving")))
    oos = experiments.select("experiment_id", "graduated").join(best_trials(trials), "experiment_id")
    diagnostics = F.broadcast(oos.agg(*_diagnostic("best.walk_oos", "walk_finalists"), *_diagnostic(F.when(F.col("graduated"), F.col("best.walk_oos")), "walk_graduates")))
    return marked.agg(
        F.count("*").alias("n_experiments"), F.countDistinct("symbol").alias("n_symbols"), F.sum("lifetime_trials").alias("n_trials"), F.count_if("graduated").alias("n_graduates"),
        F.median("n_bars").alias("median_bars"), F.median(F.when(F.col("graduated"), F.col("years"))).alias("median_years"),
    ).crossJoin(board).crossJoin(diagnostics)


def frontier(experiments: DataFrame, power: float = 0.8) -> DataFrame:
    """One row: the bar of the pool's symbols at its graduates' median holdout, and the true ratio that clears it with a power.

    That ratio is the bar and so many of its own standard errors, a quadratic equation; null where the holdout is too short for a solution, or
    nothing has graduated.
    """
    z2 = quantile(power) ** 2
    own = experiments.agg(F.countDistinct("symbol").alias("n_symbols"), (F.median(F.when(F.col("graduated"), F.col("holdout_bars"))) / YEAR).alias("years"))
    own = own.withColumn("bar", F.when(F.col("years") > 0, null_bar(F.col("n_symbols"), F.col("years"))))
    rest = 1 - z2 / (SQUARED * F.col("years"))
    root = F.sqrt(F.col("bar") * F.col("bar") - rest * (F.col("bar") * F.col("bar") - z2 / F.col("years")))
    own = own.withColumn("detectable", F.when(rest > 0, (F.col("bar") + (root if power >= 0.5 else -root)) / rest))
    return own.withColumn("error", F.sqrt((1 + F.col("detectable") * F.col("detectable") / SQUARED) / F.col("years")))


def frozen(experiments: DataFrame, trials: DataFrame, at: Column) -> DataFrame:
    """The positions of the graduates, frozen at a time, with the bar and the verdict that they were taken with."""
    rows = _with_bar(experiments.withColumn("_at", at)).where("graduated").join(best_trials(trials), "experiment_id")
    return rows.select("experiment_id", "symbol", F.col("best.family").alias("family"), F.col("_at").alias("frozen_at"), "bar", "survives", "n_symbols")


def newly_promoted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions of ``after`` whose symbol and family ``before`` does not hold."""
    return after.join(before.select("symbol", "family"), ["symbol", "family"], "left_anti")


def cohorts(scored: DataFrame) -> DataFrame:
    """Forward results of positions by whether they survived deflation when frozen: survived, failed or unknown."""
    cohort = F.when(F.col("survives"), "survived").when(~F.col("survives"), "failed").otherwise("unknown")
    return scored.groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"), F.avg("forward_sharpe").alias("mean_sharpe"), F.median("forward_sharpe").alias("median_sharpe"))


def yield_rates(runs: DataFrame) -> DataFrame:
    """(run, attempted, rate) of ``runs(run, outcome)``: experiments among what was fetched; what a screen filtered was not attempted."""
    got, lost = F.count_if(F.col("outcome") == "experiment"), F.count_if(F.col("outcome") == "error")
    return runs.groupBy("run").agg((got + lost).alias("attempted"), F.when(got + lost == 0, 1.0).otherwise(got / (got + lost)).alias("rate"))


#: Fixed value: a run that produces less than this share of what it fetched has failed.
LEAST_YIELD = 0.25


def require_yield(rates: DataFrame, least: float = LEAST_YIELD) -> DataFrame:
    """``rates``, or an error where a run's rate is under ``least``: a vendor that fails is no empty result."""
    low = F.raise_error(F.concat(F.lit("the yield is too low in run "), F.col("run").cast("string"))).cast("double")
    return rates.withColumn("rate", F.when(F.col("rate") >= least, F.col("rate")).otherwise(low))


def compared_sweeps(base: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of two power sweeps ``(cell, rate, n)``, matched or not: the gain, if both have measured the cell."""
    both = base.withColumnsRenamed({"rate": "base_rate", "n": "base_n"}).join(new.withColumnsRenamed({"rate": "new_rate", "n": "new_n"}), "cell", "full")
    reason = F.when(F.col("base_n").isNull(), "only in the new sweep").when(F.col("new_n").isNull(), "only in the base sweep")
    return both.select("cell", "base_rate", "new_rate", (F.col("new_rate") - F.col("base_rate")).alias("gain"), reason.isNull().alias("attributable"), F.coalesce(reason, F.lit("")).alias("reason"))


def reconciled(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """Orders that turn ``held(symbol, shares)`` into ``wanted(symbol, shares)``; a position that changes side is closed first."""
    both = held.withColumnRenamed("shares", "h").join(wanted.withColumnRenamed("shares", "w"), "symbol", "full")
    both = both.select("symbol", F.coalesce("h", F.lit(0)).alias("h"), F.coalesce("w", F.lit(0)).alias("w"))
    turned = F.col("h") * F.col("w") < 0
    legs = F.when(turned, F.array(-F.col("h"), F.col("w"))).when(F.col("h") != F.col("w"), F.array(F.col("w") - F.col("h"))).otherwise(F.array().cast("array<bigint>"))
    leg = both.select("symbol", F.posexplode(legs.cast("array<bigint>")).alias("leg", "shares"))
    return leg.select("symbol", F.col("leg").cast("long").alias("leg"), F.when(F.col("shares") > 0, "buy").otherwise("sell").alias("side"), F.abs("shares").alias("shares"))


# The driver's tables as a pool: an order is an experiment of its customer, its line items are the trials.


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("experiment_id"), F.format_string("C%07d", "o_custkey").alias("symbol"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("version"),
        F.floor(F.col("o_totalprice") / 1000).alias("lifetime_trials"), F.floor(F.col("o_totalprice") / 40).alias("n_bars"), (F.col("o_orderstatus") == "F").alias("graduated"),
        (F.col("o_totalprice") / 150000).alias("holdout_sharpe"), (252 + F.floor(F.col("o_totalprice") / 100)).alias("holdout_bars"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By experiment in tasks of a bounded size: whatever groups or joins by experiment has no further exchange, and no map of a whole split."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("experiment_id"), F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber").cast("string")).alias("family"),
        (F.col("l_tax") * 50 - F.col("l_discount") * 20).alias("deflated"), (F.col("l_quantity") / 25 - 1).alias("walk_oos")).repartition(tasks_of(line), "experiment_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool as documents and back: each order is written as one, with its line items as trials, and parsed."""
    rows = experiments(spark, sf_dir)
    each = trials(spark, sf_dir).groupBy("experiment_id").agg(F.collect_list(F.struct(F.col("family").alias("strategy_name"), F.col("deflated").alias("deflated_sharpe"), F.col("walk_oos").alias("walk_forward_oos_sharpe"))).alias("trials"))
    graduate = F.when(F.col("graduated"), F.struct("holdout_sharpe", F.col("holdout_bars").alias("holdout_n_bars")))
    whole = rows.join(each, "experiment_id", "left").select(F.to_json(F.struct(
        F.col("experiment_id").cast("string").alias("experiment_id"), F.col("created").cast("date").cast("string").alias("created_at"), "symbol", F.col("version").alias("search_config_version"),
        "lifetime_trials", "n_bars", "trials", graduate.alias("graduate"))).alias("json"))
    return documents.parsed(whole, "json", documents.EXPERIMENT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    six = lambda *names: [F.round(n, 6).alias(n) for n in names]
    both = lambda s, d: (experiments(s, d), trials(s, d))
    at = lambda: F.lit("2001-08-02")
    per_nation = lambda df, key, balance: df.groupBy(F.col(key).alias("cell")).agg(F.avg(F.when(F.col(balance) > 0, 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("n"))
    net = lambda df, key, balance: df.groupBy(F.col(key).alias("symbol")).agg(F.sum(F.signum(balance)).cast("long").alias("shares"))

    def scored(s: SparkSession, d: str) -> DataFrame:
        book = frozen(*both(s, d), at()).withColumn("survives", F.when(F.length("symbol") > 0, F.col("survives")))
        line = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("experiment_id")).agg((F.avg("l_quantity") / 25 - 1).alias("forward_sharpe"))
        return book.join(line, "experiment_id")

    return {
        "retain_recent": lambda s, d: retain_recent(experiments(s, d)).select("experiment_id", "symbol"),
        "pool_merge": lambda s, d: merged(experiments(s, d).select("experiment_id", "version"), trials(s, d).groupBy("experiment_id").agg(F.max("family").alias("version"))),
        "prior_trials": lambda s, d: prior_trials(experiments(s, d)),
        "rank_experiments": lambda s, d: leaderboard(*both(s, d)).select("symbol", "family", "graduated", F.col("survives").cast("string").alias("survives"), *six("deflated", "holdout_sharpe")),
        "near_misses": lambda s, d: near_misses(*both(s, d)).select("symbol", "family", *six("ratio")),
        "pool_report": lambda s, d: summary(*both(s, d)).select("n_experiments", "n_symbols", "n_trials", "n_graduates", "n_leaderboard_graduates", "n_surviving", *[f"walk_{w}_n" for w in ("finalists", "graduates")],
            *six("median_bars", "median_years", *(f"walk_{w}{x}" for w in ("finalists", "graduates") for x in ("", "_p95", "_max")))),
        "frontier": lambda s, d: frontier(experiments(s, d)).select("n_symbols", *six("years", "bar", "detectable", "error")),
        "search_versions": lambda s, d: versions(experiments(s, d)),
        "documents_experiments": lambda s, d: documents.experiments(_documents(s, d)).select("experiment_id", "symbol", "created", "version", "lifetime_trials", "n_bars", "graduated", "holdout_bars", *six("holdout_sharpe")),
        "documents_trials": lambda s, d: documents.trials(_documents(s, d)).select("experiment_id", "symbol", "family", "n_configs", *six("deflated", "walk_oos")),
        "documents_latest": lambda s, d: documents.latest(_documents(s, d)).select("experiment_id", "symbol", F.col("created_at").alias("created")),
        "freeze_graduates": lambda s, d: frozen(*both(s, d), at()).select("experiment_id", "symbol", "family", "frozen_at", "survives", "n_symbols", *six("bar")),
        "newly_promoted": lambda s, d: newly_promoted(frozen(*both(s, d), at()), leaderboard(*both(s, d))).select("symbol", "family"),
        "cohorts": lambda s, d: cohorts(scored(s, d)).select("cohort", "n", *six("mean_sharpe", "median_sharpe")),
        "yield_rate": lambda s, d: yield_rates(table(s, d, "orders").select(F.col("o_orderpriority").alias("run"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'experiment' WHEN 'O' THEN 'error' ELSE 'filtered' END").alias("outcome"))).select("run", "attempted", *six("rate")),
        "power_compare": lambda s, d: compared_sweeps(per_nation(table(s, d, "supplier"), "s_nationkey", "s_acctbal"), per_nation(table(s, d, "customer"), "c_nationkey", "c_acctbal")).select("cell", "attributable", "reason", *six("base_rate", "new_rate", "gain")),
        "reconcile": lambda s, d: reconciled(net(table(s, d, "supplier"), "s_nationkey", "s_acctbal"), net(table(s, d, "customer"), "c_nationkey", "c_acctbal")),
    }


def oracle_sql() -> dict[str, str]:
    base = """WITH e AS (SELECT o_orderkey AS experiment_id, 'C' || lpad(o_custkey::VARCHAR, 7, '0') AS symbol, o_orderdate AS created, o_orderpriority AS version, CAST(floor(o_totalprice / 1000) AS BIGINT) AS lifetime_trials,
            floor(o_totalprice / 40) AS n_bars, o_orderstatus = 'F' AS graduated, o_totalprice / 150000 AS holdout_sharpe, (252 + floor(o_totalprice / 100)) / 252 AS years FROM orders),
        t AS (SELECT l_orderkey AS experiment_id, l_returnflag || '-' || l_linenumber AS family, l_tax * 50 - l_discount * 20 AS deflated, l_quantity / 25 - 1 AS walk_oos FROM lineitem),
        b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY experiment_id ORDER BY deflated DESC, family, walk_oos) = 1),
        n AS (SELECT count(DISTINCT symbol) AS n_symbols FROM e),
        m AS (SELECT *, sqrt(1 / years) * sqrt(2 * ln(n_symbols)) AS bar FROM e, n),
        j AS (SELECT m.*, family, deflated, walk_oos, CASE WHEN graduated THEN holdout_sharpe > bar END AS survives FROM m JOIN b USING (experiment_id)),
        l AS (SELECT symbol, family, graduated, deflated, CASE WHEN graduated THEN holdout_sharpe END AS holdout_sharpe, survives FROM j QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY graduated DESC, deflated DESC, experiment_id) = 1) """
    nations = """SELECT coalesce(a.k, b.k) AS {key}, a.*, b.* FROM (SELECT s_nationkey AS k, {one} FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, {two} FROM customer GROUP BY 1) b ON a.k = b.k"""
    rates = nations.format(key="cell", one="avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0 END) AS base_rate", two="avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END) AS new_rate")
    sides = nations.format(key="symbol", one="CAST(sum(sign(s_acctbal)) AS BIGINT) AS h_", two="CAST(sum(sign(c_acctbal)) AS BIGINT) AS w_")
    order = "CASE WHEN {x} > 0 THEN 'buy' ELSE 'sell' END AS side, abs({x}) AS shares"
    bodies = {
        "retain_recent": "SELECT experiment_id, symbol FROM e WHERE graduated UNION ALL SELECT experiment_id, symbol FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created DESC, experiment_id DESC) AS k FROM e WHERE NOT graduated) WHERE k <= 5",
        "pool_merge": "SELECT experiment_id, coalesce(family, version) AS version FROM (SELECT experiment_id, version FROM e) FULL JOIN (SELECT experiment_id, max(family) AS family FROM t GROUP BY 1) USING (experiment_id)",
        "prior_trials": "SELECT symbol, max(lifetime_trials) AS trials FROM e GROUP BY symbol",
        "rank_experiments": "SELECT symbol, family, graduated, survives::VARCHAR AS survives, round(deflated, 6) AS deflated, round(holdout_sharpe, 6) AS holdout_sharpe FROM l",
        "near_misses": "SELECT symbol, family, round(ratio, 6) AS ratio FROM (SELECT symbol, family, max(holdout_sharpe / bar) AS ratio FROM j WHERE graduated AND holdout_sharpe <= bar GROUP BY symbol, family) ORDER BY round(ratio, 9) DESC, symbol, family LIMIT 10",
        "pool_report": """SELECT (SELECT count(*) FROM e) AS n_experiments, (SELECT n_symbols FROM n) AS n_symbols, (SELECT CAST(sum(lifetime_trials) AS BIGINT) FROM e) AS n_trials, (SELECT count(*) FROM e WHERE graduated) AS n_graduates,
            (SELECT count(*) FROM l WHERE graduated) AS n_leaderboard_graduates, (SELECT count(*) FROM l WHERE survives) AS n_surviving, (SELECT round(median(n_bars), 6) FROM e) AS median_bars,
            (SELECT round(median(years), 6) FROM e WHERE graduated) AS median_years, (SELECT round(median(walk_oos), 6) FROM j) AS walk_finalists, (SELECT round(median(walk_oos), 6) FROM j WHERE graduated) AS walk_graduates,
            (SELECT count(walk_oos) FROM j) AS walk_finalists_n, (SELECT count(walk_oos) FROM j WHERE graduated) AS walk_graduates_n, (SELECT round(quantile_cont(walk_oos, 0.95), 6) FROM j) AS walk_finalists_p95,
            (SELECT round(quantile_cont(walk_oos, 0.95), 6) FROM j WHERE graduated) AS walk_graduates_p95, (SELECT round(max(walk_oos), 6) FROM j) AS walk_finalists_max, (SELECT round(max(walk_oos), 6) FROM j WHERE graduated) AS walk_graduates_max""",
        "documents_experiments": """SELECT experiment_id::VARCHAR AS experiment_id, symbol, CAST(CAST(created AS DATE) AS VARCHAR) AS created, version, lifetime_trials, CAST(n_bars AS BIGINT) AS n_bars, graduated,
            CASE WHEN graduated THEN CAST(years * 252 AS BIGINT) END AS holdout_bars, CASE WHEN graduated THEN round(holdout_sharpe, 6) END AS holdout_sharpe FROM e""",
        "documents_trials": "SELECT experiment_id::VARCHAR AS experiment_id, symbol, family, CAST(1 AS BIGINT) AS n_configs, round(deflated, 6) AS deflated, round(walk_oos, 6) AS walk_oos FROM t JOIN e USING (experiment_id)",
        "documents_latest": "SELECT experiment_id::VARCHAR AS experiment_id, symbol, CAST(CAST(created AS DATE) AS VARCHAR) AS created FROM e ORDER BY CAST(created AS DATE) DESC, experiment_id::VARCHAR DESC LIMIT 1",
        "frontier": f"""SELECT n_symbols, round(years, 6) AS years, round(bar, 6) AS bar, round(sr, 6) AS detectable, round(sqrt((1 + sr * sr / {SQUARED}) / years), 6) AS error FROM
            (SELECT *, list_reduce(list_prepend(bar, list_transform(range(12), lambda k: bar)), lambda a, b: b + {quantile(0.8)!r} * sqrt((1 + a * a / {SQUARED}) / years)) AS sr FROM
                (SELECT n_symbols, years, sqrt(1 / years) * sqrt(2 * ln(n_symbols)) AS bar FROM n, (SELECT median(years) AS years FROM e WHERE graduated)))""",
        "search_versions": "SELECT version, count(*) AS n FROM e GROUP BY version",
        "freeze_graduates": "SELECT experiment_id, symbol, family, '2001-08-02' AS frozen_at, survives, n_symbols, round(bar, 6) AS bar FROM j WHERE graduated",
        "newly_promoted": "SELECT symbol, family FROM l WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.graduated AND j.symbol = l.symbol AND j.family = l.family)",
        "cohorts": """SELECT CASE WHEN survives THEN 'survived' ELSE 'failed' END AS cohort, count(*) AS n, round(avg(f), 6) AS mean_sharpe, round(median(f), 6) AS median_sharpe
            FROM j JOIN (SELECT l_orderkey AS experiment_id, avg(l_quantity) / 25 - 1 AS f FROM lineitem GROUP BY 1) USING (experiment_id) WHERE graduated GROUP BY 1""",
        "yield_rate": "SELECT o_orderpriority AS run, count(*) FILTER (o_orderstatus IN ('F', 'O')) AS attempted, round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus IN ('F', 'O')), 6) AS rate FROM orders GROUP BY 1",
        "power_compare": f"SELECT cell, base_rate IS NOT NULL AND new_rate IS NOT NULL AS attributable, CASE WHEN base_rate IS NULL THEN 'only in the new sweep' WHEN new_rate IS NULL THEN 'only in the base sweep' ELSE '' END AS reason, round(base_rate, 6) AS base_rate, round(new_rate, 6) AS new_rate, round(new_rate - base_rate, 6) AS gain FROM ({rates})",
        "reconcile": f"""SELECT symbol, leg, side, shares FROM (SELECT symbol, CAST(0 AS BIGINT) AS leg, {order.format(x='(CASE WHEN h * w < 0 THEN -h ELSE w - h END)')} FROM x WHERE h <> w
            UNION ALL SELECT symbol, 1, {order.format(x='w')} FROM x WHERE h * w < 0)""",
    }
    out = {name: base + body for name, body in bodies.items()}
    out["reconcile"] = f"WITH x AS (SELECT symbol, coalesce(h_, 0) AS h, coalesce(w_, 0) AS w FROM ({sides})) " + bodies["reconcile"]
    return out
