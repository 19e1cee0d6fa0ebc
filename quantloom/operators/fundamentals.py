"""Quality, safety, distress, valuation and screens over filed histories.

``history`` is one row per symbol and fiscal year, as :func:`quantloom.sources.edgar.history` gives it; an
item that was not reported is null and never counts in a company's favour. Every operator is one window over a
symbol's years or one aggregation by symbol, so that all of them share one exchange.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources import edgar
from quantloom.sources.bars import table

#: The nine signals of the score, on the latest year (t) and the one before (p).
SIGNALS: dict[str, str] = {
    "roa_positive": "t.net_income / t.assets > 0",
    "cfo_positive": "t.operating_cash > 0",
    "delta_roa_positive": "t.net_income / t.assets > p.net_income / p.assets",
    "accruals_quality": "t.operating_cash / t.assets > t.net_income / t.assets",
    "delta_leverage_negative": "t.debt / t.assets < p.debt / p.assets",
    "delta_current_ratio_positive": "t.current_assets / t.current_liabilities > p.current_assets / p.current_liabilities",
    "no_dilution": "t.shares <= p.shares",
    "delta_gross_margin_positive": "t.gross / t.revenue > p.gross / p.revenue",
    "delta_asset_turnover_positive": "t.revenue / t.assets > p.revenue / p.assets",
}
_DENOMINATORS = ("assets", "current_liabilities", "revenue")


def latest_pairs(history: DataFrame) -> DataFrame:
    """(symbol, t, p): each symbol's latest year and the one filed before it (null if there is none); zero denominators are null."""
    usable = history.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in _DENOMINATORS})
    by_year = Window.partitionBy("symbol").orderBy("fy")
    year = F.struct(*[c for c in usable.columns if c != "symbol"])
    return (
        usable.select("symbol", year.alias("t"), F.lag(year).over(by_year).alias("p"), F.lead("fy").over(by_year).alias("next"))
        .where("next IS NULL").drop("next")
    )


def f_score(pairs: DataFrame) -> DataFrame:
    """``pairs`` plus the nine booleans and f_score, their sum; a company with one year has none of them."""
    flags = {name: F.col("p").isNotNull() & F.coalesce(F.expr(rule), F.lit(False)) for name, rule in SIGNALS.items()}
    scored = pairs.withColumns(flags)
    return scored.withColumn("f_score", reduce(Column.__add__, [F.col(n).cast("int") for n in SIGNALS]))


def safety(pairs: DataFrame) -> DataFrame:
    """``pairs`` plus leverage (liabilities over assets), current_ratio and deficit (negative retained earnings)."""
    return pairs.withColumns({
        "leverage": F.expr("(t.assets - t.equity) / t.assets"),
        "current_ratio": F.expr("t.current_assets / t.current_liabilities"),
        "deficit": F.expr("t.retained < 0"),
    })


def mean_of(*legs: Column) -> Column:
    """Mean of the columns that are not null; null if all are."""
    known = F.array_compact(F.array(*legs))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def _unit(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def quality(history: DataFrame) -> DataFrame:
    """One row per symbol: f_score with its booleans, gross_profitability, safety and quality, the mean of the legs there are."""
    scored = safety(f_score(latest_pairs(history))).withColumn("gross_profitability", F.expr("t.gross / t.assets"))
    legs = (
        F.col("f_score") / 9.0,
        _unit(F.col("gross_profitability") / 0.5),
        mean_of(_unit(1.0 - F.col("leverage")), _unit(F.col("current_ratio") / 3.0), F.when(F.col("deficit"), 0.0).when(~F.col("deficit"), 1.0)),
    )
    flags = F.array_compact(F.array(
        F.when(legs[1].isNull(), "no gross profitability"), F.when(legs[2].isNull(), "no financial safety"),
    ))
    return scored.withColumns({"quality": mean_of(*legs), "quality_flags": flags})


def distress(pairs: DataFrame) -> DataFrame:
    """``pairs`` plus distressed and its reasons: a loss and cash burnt, and either more liabilities than assets or a current ratio under one.

    What was not reported trips nothing.
    """
    judged = safety(pairs)
    signs = {
        "loss": F.expr("t.net_income < 0"), "cash burnt": F.expr("t.operating_cash < 0"),
        "liabilities exceed assets": F.col("leverage") > 1.0, "current ratio under one": F.col("current_ratio") < 1.0,
    }
    loss, burnt, insolvent, illiquid = (F.coalesce(x, F.lit(False)) for x in signs.values())
    found = F.array_compact(F.array(*[F.when(x, name) for name, x in signs.items()]))
    return judged.withColumn("distressed", loss & burnt & (insolvent | illiquid)).withColumn("reasons", F.when(F.col("distressed"), found).otherwise(F.array()))


def attach_prices(history: DataFrame, closes: DataFrame) -> DataFrame:
    """``history`` plus price, the latest of ``closes(symbol, ts, close)`` on or before the fiscal year's last day; null before the first."""
    end = F.make_date("fy", F.lit(12), F.lit(31))
    wanted = history.select("symbol", end.alias("ts"), F.lit(None).cast("double").alias("close"), F.struct(*history.columns).alias("year"))
    known = closes.select("symbol", F.col("ts").cast("date").alias("ts"), "close", F.lit(None).cast(wanted.schema["year"].dataType).alias("year"))
    upto = Window.partitionBy("symbol").orderBy("ts", F.col("year").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return known.unionByName(wanted).withColumn("price", F.last("close", ignorenulls=True).over(upto)).where("year IS NOT NULL").select("year.*", "price")


def multiples(history: DataFrame, prices: DataFrame) -> DataFrame:
    """P/E and P/S at ``prices(symbol, close)`` against the latest filing, and the share of the own history strictly below.

    ``history`` has a price for each year. A multiple needs a positive denominator, a percentile two past multiples.
    """
    priced = history.withColumns({
        "past_pe": F.expr("CASE WHEN price > 0 AND eps > 0 THEN price / eps END"),
        "past_ps": F.expr("CASE WHEN price > 0 AND shares > 0 AND revenue > 0 THEN price * shares / revenue END"),
    })
    by_symbol = priced.groupBy("symbol").agg(
        F.max_by(F.struct("fy", "eps", "shares", "revenue"), "fy").alias("t"), F.collect_list("past_pe").alias("pes"), F.collect_list("past_ps").alias("pss")
    )
    now = by_symbol.join(prices.select("symbol", "close"), "symbol").withColumns({
        "pe": F.expr("CASE WHEN t.eps > 0 THEN close / t.eps END"),
        "ps": F.expr("CASE WHEN t.revenue > 0 THEN close * t.shares / t.revenue END"),
    })
    below = lambda now, past: F.when(F.size(past) >= 2, F.size(F.filter(past, lambda x: x < F.col(now))) / F.size(past))
    return now.select(
        "symbol", F.col("t.fy").alias("fy"), "close", "pe", "ps",
        F.when(F.col("pe").isNotNull(), below("pe", "pes")).alias("pe_percentile"), F.when(F.col("ps").isNotNull(), below("ps", "pss")).alias("ps_percentile"),
        F.size("pes").alias("pe_n"), F.size("pss").alias("ps_n"),
    )


def _growth(item: str) -> Column:
    """Compound growth from the first to the last year, if the item was reported and positive in all of at least two."""
    whole = F.count(F.when(F.col(item) > 0, 1)) == F.count(F.lit(1))
    ratio = F.max_by(item, "fy") / F.min_by(item, "fy")
    return F.when(whole & (F.count(F.lit(1)) >= 2), F.pow(ratio, 1.0 / (F.count(F.lit(1)) - 1)) - 1)


def intrinsic(history: DataFrame, *, rate: float = 0.10, terminal: float = 0.025, years: int = 5, most: float = 0.12) -> DataFrame:
    """Discounted cash flow per share: base (free cash flow, else net income), growth and value; null where it has no meaning.

    Growth is that of free cash flow, else of net income, else of revenue, else the terminal one, within 0 and ``most``.
    """
    by_symbol = history.groupBy("symbol").agg(
        F.max_by(F.struct("free_cash", "net_income", "shares"), "fy").alias("t"), F.coalesce(*[_growth(i) for i in ("free_cash", "net_income", "revenue")]).alias("seen")
    )
    base = F.coalesce("t.free_cash", "t.net_income")
    valued = by_symbol.select(
        "symbol", base.alias("base"), (F.col("t.free_cash").isNull() & F.col("t.net_income").isNotNull()).alias("is_proxy"), F.col("t.shares").alias("shares"),
        F.least(F.greatest(F.coalesce("seen", F.lit(terminal)), F.lit(0.0)), F.lit(most)).alias("growth"),
    ).withColumn("sound", F.coalesce((F.col("base") > 0) & (F.col("shares") > 0), F.lit(False)))
    step = (1 + F.col("growth")) / (1 + rate)
    flows = F.aggregate(F.sequence(F.lit(1), F.lit(years)), F.lit(0.0), lambda a, k: a + F.pow(step, k))
    value = F.col("base") * (flows + F.pow(step, F.lit(years)) * ((1 + terminal) / (rate - terminal))) / F.col("shares")
    return valued.select("symbol", "base", "is_proxy", F.when(F.col("sound"), F.col("growth")).alias("growth"), F.when(F.col("sound"), value).alias("value"))


def valuation(history: DataFrame, prices: DataFrame) -> DataFrame:
    """Multiples, intrinsic value, margin_of_safety and undervaluation, the mean of what there is of cheapness by P/E, by P/S, and the margin."""
    both = multiples(history, prices).join(intrinsic(history), "symbol")
    margin = F.when(F.col("value") > 0, (F.col("value") - F.col("close")) / F.col("value"))
    both = both.withColumn("margin_of_safety", margin)
    return both.withColumn("undervaluation", mean_of(1 - F.col("pe_percentile"), 1 - F.col("ps_percentile"), _unit(F.col("margin_of_safety"))))


def records(history: DataFrame, prices: DataFrame) -> DataFrame:
    """The fundamentals pool's row of each symbol: quality, value and, where both are known, their product."""
    value = valuation(history, prices).select("symbol", "undervaluation", "margin_of_safety")
    return (
        quality(history).join(value, "symbol", "left")
        .select("symbol", F.col("t.fy").alias("fy"), "quality", F.col("undervaluation").alias("value"), (F.col("quality") * F.col("undervaluation")).alias("combined"),
            "f_score", "gross_profitability", "margin_of_safety")
    )


def merged_records(pool: DataFrame, incoming: DataFrame, key: str = "symbol") -> DataFrame:
    """One record a company: the newer filing year, of equals the incoming one."""
    both = pool.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("fy"), F.desc("_new"))
    return both.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k", "_new")


def ranked(pool: DataFrame, by: str = "combined", top: int | None = None) -> DataFrame:
    """Records that have the score, best first; ties by symbol. ``top`` is a report's length."""
    listed = pool.where(F.col(by).isNotNull()).orderBy(F.desc(by), "symbol")
    return listed if top is None else listed.limit(top)


def _screened(df: DataFrame, failures: dict[str, Column]) -> DataFrame:
    reasons = F.array_compact(F.array(*[F.when(x, name) for name, x in failures.items()]))
    return df.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def screen_fundamentals(snapshot: DataFrame, growth: float | None = 0.0, margin: float | None = 0.0) -> DataFrame:
    """``snapshot(growth, net_margin)`` plus reasons and passed; a metric that is not known fails, a bound of None is not asked."""
    asked = {c: x for c, x in (("growth", growth), ("net_margin", margin)) if x is not None}
    failures = {f"{c} unknown": F.col(c).isNull() for c in asked} | {f"{c} too low": F.coalesce(F.col(c) < x, F.lit(False)) for c, x in asked.items()}
    return _screened(snapshot, failures)


def screen_value(pool: DataFrame, least: float = 0.5, *, keep_unscored: bool = True, margin: bool = False) -> DataFrame:
    """``pool(value, margin_of_safety)`` plus reasons and passed; one without a score passes iff ``keep_unscored``."""
    scored = F.col("value").isNotNull()
    failures = {"no value score": ~scored & F.lit(not keep_unscored), "not cheap enough": scored & (F.col("value") < least)}
    if margin:
        failures["no margin of safety"] = scored & (F.coalesce("margin_of_safety", F.lit(0.0)) <= 0)
    return _screened(pool, failures)


def screen_quality(pool: DataFrame, least: float = 0.5, *, f_floor: int | None = None, keep_unscored: bool = True) -> DataFrame:
    """``pool(quality, f_score)`` plus reasons and passed; one without a score passes iff ``keep_unscored``."""
    scored = F.col("quality").isNotNull()
    failures = {"no quality score": ~scored & F.lit(not keep_unscored), "quality too low": scored & (F.col("quality") < least)}
    if f_floor is not None:
        failures["f_score too low"] = scored & (F.col("f_score") < f_floor)
    return _screened(pool, failures)


def screened_in(universe: DataFrame, pool: DataFrame, *screens: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The symbols of ``universe`` that pass every screen; a symbol that is not in the pool is judged as unscored."""
    known = universe.select("symbol").distinct().join(pool, "symbol", "left")
    for screen in screens:
        known = screen(known).where("passed").drop("reasons", "passed")
    return known.select("symbol")


# The driver's tables as filings: every supplier files what its line items of a year amount to.

_FILED = {
    "Revenues": "sum(l_extendedprice * (1 - l_discount))",
    "CostOfRevenue": "sum(l_extendedprice * 0.6 + l_quantity * 100)",
    "NetIncomeLoss": "sum(l_extendedprice * (0.35 - l_discount - l_tax * 6) - l_quantity * 90)",
    "NetCashProvidedByUsedInOperatingActivities": "sum(l_extendedprice * (0.2 - l_tax * 5))",
    "PaymentsToAcquirePropertyPlantAndEquipment": "sum(l_extendedprice * l_discount)",
    "Assets": "sum(l_extendedprice) * 1.7",
    "AssetsCurrent": "sum(l_quantity) * 700",
    "LiabilitiesCurrent": "CASE WHEN count(*) > 2 THEN sum(l_extendedprice * l_tax) * 12 END",
    "LongTermDebtNoncurrent": "sum(l_extendedprice * l_discount) * 4",
    "RetainedEarningsAccumulatedDeficit": "CASE WHEN count(*) > 3 THEN sum(l_extendedprice * (0.3 - l_tax * 8)) END",
    "StockholdersEquity": "sum(l_extendedprice * (1.7 - l_discount * 33))",
    "WeightedAverageNumberOfDilutedSharesOutstanding": "count(*) * 100.0",
    "EarningsPerShareDiluted": "sum(l_extendedprice * (0.35 - l_discount - l_tax * 6) - l_quantity * 90) / (count(*) * 100.0)",
}
_UNITS = {"WeightedAverageNumberOfDilutedSharesOutstanding": "shares", "EarningsPerShareDiluted": "USD/shares"}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company-facts documents of the suppliers, one exchange by supplier and year and one by supplier."""
    line = table(spark, sf_dir, "lineitem").withColumns({"symbol": F.format_string("S%06d", "l_suppkey"), "fy": F.year("l_shipdate")})
    years = line.groupBy("symbol", "fy").agg(*[F.round(F.expr(x).cast("double"), 4).alias(tag) for tag, x in _FILED.items()])
    row = lambda tag: F.when(F.col(tag).isNotNull(), F.struct(
        F.concat("fy", F.lit("-12-31")).alias("end"), F.col(tag).alias("val"), "fy", F.lit("FY").alias("fp"), F.lit("10-K").alias("form"),
        F.concat(F.col("fy") + 1, F.lit("-02-01")).alias("filed"), F.concat(F.lit("a"), F.col("fy")).alias("accn")))
    facts = years.groupBy("symbol").agg(*[F.collect_list(row(tag)).alias(tag) for tag in _FILED])
    tags = F.create_map(*[x for tag in _FILED for x in (F.lit(tag), F.struct(F.create_map(F.lit(_UNITS.get(tag, "USD")), F.col(tag)).alias("units")))])
    return facts.select(F.to_json(F.struct(F.col("symbol").alias("entityName"), F.struct(tags.alias("us-gaap")).alias("facts"))).alias("json"))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, close): a supplier's mean unit price by day, in cents of 1,000 shares' worth."""
    line = table(spark, sf_dir, "lineitem")
    price = F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 100 + 1e-9, 6)  # no ties
    return line.groupBy(F.format_string("S%06d", "l_suppkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts")).agg(price.alias("close"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edgar.history(filings(spark, sf_dir))


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_prices(_history(spark, sf_dir), closes(spark, sf_dir))


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closes(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "ts").alias("close"))


def _six(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    pool = lambda s, d: records(_priced(s, d), _last(s, d))
    text = lambda: F.array_join("reasons", "; ").alias("reasons")
    return {
        "f_score": lambda s, d: f_score(latest_pairs(_history(s, d))).select("symbol", F.col("t.fy").alias("fy"), *SIGNALS, F.col("f_score").cast("long").alias("f_score")),
        "gross_profitability": lambda s, d: quality(_history(s, d)).select("symbol", *_six("gross_profitability")),
        "financial_safety": lambda s, d: safety(latest_pairs(_history(s, d))).select("symbol", *_six("leverage", "current_ratio"), "deficit"),
        "quality_score": lambda s, d: quality(_history(s, d)).select("symbol", *_six("quality"), F.array_join("quality_flags", "; ").alias("flags")),
        "distress": lambda s, d: distress(latest_pairs(_history(s, d))).select("symbol", "distressed", text()),
        "fiscal_prices": lambda s, d: _priced(s, d).select("symbol", "fy", *_six("price")),
        "multiples": lambda s, d: multiples(_priced(s, d), _last(s, d)).select("symbol", "fy", *_six("pe", "ps", "pe_percentile", "ps_percentile"), F.col("pe_n").cast("long").alias("pe_n"), F.col("ps_n").cast("long").alias("ps_n")),
        "dcf": lambda s, d: intrinsic(_history(s, d)).select("symbol", "is_proxy", *_six("growth"), F.round("value", 4).alias("value")),
        "valuation_score": lambda s, d: valuation(_priced(s, d), _last(s, d)).select("symbol", *_six("margin_of_safety", "undervaluation")),
        "fundamental_records": lambda s, d: pool(s, d).select("symbol", "fy", *_six("quality", "value", "combined"), F.col("f_score").cast("long").alias("f_score")),
        "fundamental_rank": lambda s, d: ranked(pool(s, d).select("symbol", *_six("combined")), top=10),
        "screens": lambda s, d: screen_fundamentals(edgar.snapshot(filings(s, d))).select("symbol", "passed", text()),
        "screen_value": lambda s, d: screen_value(pool(s, d), margin=True).select("symbol", "passed", text()),
        "screen_quality": lambda s, d: screen_quality(pool(s, d), f_floor=4).select("symbol", "passed", text()),
    }


def base_sql() -> str:
    """The rules in the other engine's SQL, from the line items on: the common tables, r the records."""
    filed = {"revenue": "Revenues", "cogs": "CostOfRevenue", "ni": "NetIncomeLoss", "ocf": "NetCashProvidedByUsedInOperatingActivities", "capex": "PaymentsToAcquirePropertyPlantAndEquipment", "ta": "Assets",
        "ca": "AssetsCurrent", "cl": "LiabilitiesCurrent", "ltd": "LongTermDebtNoncurrent", "re": "RetainedEarningsAccumulatedDeficit", "eq": "StockholdersEquity",
        "sh": "WeightedAverageNumberOfDilutedSharesOutstanding", "eps": "EarningsPerShareDiluted"}
    sums = ", ".join(f"round(CAST({_FILED[tag]} AS DOUBLE), 4) AS {c}" for c, tag in filed.items())
    return f"""WITH y AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, CAST(year(l_shipdate) AS INT) AS fy, {sums} FROM lineitem GROUP BY ALL),
        h AS (SELECT *, revenue - cogs AS gp, ocf - capex AS fcf, row_number() OVER (PARTITION BY symbol ORDER BY fy DESC) AS back FROM y),
        t AS (SELECT * FROM h WHERE back = 1), p AS (SELECT * FROM h WHERE back = 2),
        d AS (SELECT 'S' || lpad(l_suppkey::VARCHAR, 6, '0') AS symbol, CAST(l_shipdate AS DATE) AS ts, round(avg(l_extendedprice / l_quantity) / 100 + 1e-9, 6) AS close FROM lineitem GROUP BY ALL),
        n AS (SELECT symbol, arg_max(close, ts) AS close FROM d GROUP BY symbol),
        hp AS (SELECT h.*, d.close AS price FROM h ASOF LEFT JOIN d ON h.symbol = d.symbol AND make_date(h.fy, 12, 31) >= d.ts),
        f AS (SELECT t.symbol, t.fy, p.symbol IS NOT NULL AND coalesce(t.ni / t.ta > 0, false) AS roa_positive, p.symbol IS NOT NULL AND coalesce(t.ocf > 0, false) AS cfo_positive,
            coalesce(t.ni / t.ta > p.ni / p.ta, false) AS delta_roa_positive, p.symbol IS NOT NULL AND coalesce(t.ocf > t.ni, false) AS accruals_quality,
            coalesce(t.ltd / t.ta < p.ltd / p.ta, false) AS delta_leverage_negative, coalesce(t.ca / nullif(t.cl, 0) > p.ca / nullif(p.cl, 0), false) AS delta_current_ratio_positive,
            coalesce(t.sh <= p.sh, false) AS no_dilution, coalesce(t.gp / t.revenue > p.gp / p.revenue, false) AS delta_gross_margin_positive,
            coalesce(t.revenue / t.ta > p.revenue / p.ta, false) AS delta_asset_turnover_positive FROM t LEFT JOIN p USING (symbol)),
        fs AS (SELECT *, {' + '.join(f'CAST({k} AS BIGINT)' for k in SIGNALS)} AS f_score FROM f),
        s AS (SELECT symbol, 1 - eq / ta AS leverage, ca / nullif(cl, 0) AS current_ratio, re < 0 AS deficit FROM t),
        q AS (SELECT symbol, gp / ta AS gross_profitability, list_avg(list_filter([greatest(least(1 - leverage, 1), 0), CASE WHEN current_ratio IS NOT NULL THEN greatest(least(current_ratio / 3, 1), 0) END,
            CASE WHEN deficit IS NOT NULL THEN CASE WHEN deficit THEN 0 ELSE 1 END END], lambda x: x IS NOT NULL)) AS safe FROM t JOIN s USING (symbol)),
        qs AS (SELECT symbol, (f_score / 9.0 + greatest(least(gross_profitability / 0.5, 1), 0) + safe) / 3 AS quality FROM fs JOIN q USING (symbol)),
        m AS (SELECT symbol, t.fy, n.close, CASE WHEN t.eps > 0 THEN n.close / t.eps END AS pe, n.close * t.sh / t.revenue AS ps FROM t JOIN n USING (symbol)),
        past AS (SELECT symbol, CASE WHEN eps > 0 AND price > 0 THEN price / eps END AS pe_, CASE WHEN price > 0 THEN price * sh / revenue END AS ps_ FROM hp),
        mm AS (SELECT m.symbol, m.fy, m.close, m.pe, m.ps, count(pe_) AS pe_n, count(ps_) AS ps_n, CASE WHEN m.pe IS NOT NULL AND count(pe_) >= 2 THEN count(*) FILTER (pe_ < m.pe) / count(pe_) END AS pe_percentile,
            CASE WHEN count(ps_) >= 2 THEN count(*) FILTER (ps_ < m.ps) / count(ps_) END AS ps_percentile FROM m JOIN past USING (symbol) GROUP BY m.symbol, m.fy, m.close, m.pe, m.ps),
        g AS (SELECT symbol, count(*) AS n, min(fcf) AS a, min(ni) AS b, arg_max(fcf, fy) / arg_min(fcf, fy) AS rf, arg_max(ni, fy) / arg_min(ni, fy) AS rn, arg_max(revenue, fy) / arg_min(revenue, fy) AS rr FROM h GROUP BY symbol),
        gg AS (SELECT symbol, greatest(least(CASE WHEN n < 2 THEN 0.025 ELSE pow(CASE WHEN a > 0 THEN rf WHEN b > 0 THEN rn ELSE rr END, 1.0 / (n - 1)) - 1 END, 0.12), 0) AS growth FROM g),
        v AS (SELECT symbol, CASE WHEN fcf > 0 THEN growth END AS growth, CASE WHEN fcf > 0 THEN (list_sum(list_transform(range(1, 6), lambda k: fcf * pow(1 + growth, k) / pow(1.1, k)))
            + fcf * pow(1 + growth, 5) * 1.025 / 0.075 / pow(1.1, 5)) / sh END AS value FROM t JOIN gg USING (symbol)),
        vs AS (SELECT symbol, (value - close) / value AS margin_of_safety, list_avg(list_filter([1 - pe_percentile, 1 - ps_percentile, CASE WHEN value IS NOT NULL THEN greatest(least((value - close) / value, 1), 0) END], lambda x: x IS NOT NULL)) AS undervaluation
            FROM mm JOIN v USING (symbol)),
        r AS (SELECT fs.symbol, fs.fy, quality, undervaluation AS value, quality * undervaluation AS combined, f_score, margin_of_safety FROM fs JOIN qs USING (symbol) LEFT JOIN vs USING (symbol))
        """


def oracle_sql() -> dict[str, str]:
    base = base_sql()
    six = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
    joined = lambda *pairs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in pairs) + "], lambda x: x IS NOT NULL), '; ')"
    hard = "coalesce(t.ni < 0 AND t.ocf < 0, false) AND (coalesce(leverage > 1, false) OR coalesce(current_ratio < 1, false))"
    grown = "(SELECT t.symbol, (t.revenue - p.revenue) / abs(p.revenue) AS g, t.ni / t.revenue AS m FROM t LEFT JOIN p USING (symbol))"
    bodies = {
        "f_score": f"SELECT symbol, fy, {', '.join(SIGNALS)}, f_score FROM fs",
        "gross_profitability": f"SELECT symbol, {six('gross_profitability')} FROM q",
        "financial_safety": f"SELECT symbol, {six('leverage', 'current_ratio')}, deficit FROM s",
        "quality_score": f"SELECT symbol, {six('quality')}, '' AS flags FROM qs",
        "distress": f"SELECT symbol, {hard} AS distressed, CASE WHEN {hard} THEN 'loss; cash burnt' || CASE WHEN leverage > 1 THEN '; liabilities exceed assets' ELSE '' END || CASE WHEN current_ratio < 1 THEN '; current ratio under one' ELSE '' END ELSE '' END AS reasons FROM t JOIN s USING (symbol)",
        "fiscal_prices": f"SELECT symbol, fy, {six('price')} FROM hp",
        "multiples": f"SELECT symbol, fy, {six('pe', 'ps', 'pe_percentile', 'ps_percentile')}, pe_n, ps_n FROM mm",
        "dcf": f"SELECT symbol, false AS is_proxy, {six('growth')}, round(value, 4) AS value FROM v",
        "valuation_score": f"SELECT symbol, {six('margin_of_safety', 'undervaluation')} FROM vs",
        "fundamental_records": f"SELECT symbol, fy, {six('quality', 'value', 'combined')}, f_score FROM r",
        "fundamental_rank": "SELECT symbol, round(combined, 6) AS combined FROM r WHERE combined IS NOT NULL ORDER BY round(combined, 6) DESC, symbol LIMIT 10",
        "screens": f"SELECT symbol, coalesce(g >= 0, false) AND coalesce(m >= 0, false) AS passed, {joined(('growth unknown', 'g IS NULL'), ('net_margin unknown', 'm IS NULL'), ('growth too low', 'g < 0'), ('net_margin too low', 'm < 0'))} AS reasons FROM {grown}",
        "screen_value": f"SELECT symbol, value IS NULL OR (value >= 0.5 AND coalesce(margin_of_safety, 0) > 0) AS passed, {joined(('not cheap enough', 'value < 0.5'), ('no margin of safety', 'value IS NOT NULL AND coalesce(margin_of_safety, 0) <= 0'))} AS reasons FROM r",
        "screen_quality": f"SELECT symbol, quality >= 0.5 AND f_score >= 4 AS passed, {joined(('quality too low', 'quality < 0.5'), ('f_score too low', 'f_score < 4'))} AS reasons FROM r",
    }
    return {name: base + body for name, body in bodies.items()}
