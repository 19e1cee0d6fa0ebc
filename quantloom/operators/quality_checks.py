"""Data-quality engine: issue rows with severities, reports, the gate before the store, and the vendor normaliser.

All checks of a symbol share one exchange and one sort by (symbol, ts): pairs of neighbouring bars come from
``lag``, runs of equal closes from a running count of changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, TimestampType

from quantloom.sources.bars import ohlcv, table, tasks_of


@dataclass(frozen=True)
class Thresholds:
    """Bounds of the checks; a move and a factor's jump are flagged beyond them, a run from its length on."""

    move: str = "0.20"
    repeats: int = 5
    factor_low: str = "0.5"
    factor_high: str = "2.0"
    survivorship: bool = True
    min_bars: int = 2


ISSUE = "check string, severity string, message string, context map<string,string>"


def _issue(check: str, severity: str, message: Column, **context: Column) -> Column:
    pairs = [x for k, v in context.items() for x in (F.lit(k), v.cast("string"))]
    mapped = F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")
    return F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), message.alias("message"), mapped.alias("context"))


def weekdays_before(day: Column) -> Column:
    """Weekdays before a day since the epoch's week; differences count the weekdays in between."""
    monday = F.unix_date(day) + 3
    return F.floor(monday / 7) * 5 + F.least(F.pmod(monday, F.lit(7)), F.lit(5))


def require_zoned(bars: DataFrame) -> DataFrame:
    """``bars`` if its ts has a time zone; else an error: a naive timestamp is no contract."""
    if not isinstance(bars.schema["ts"].dataType, TimestampType):
        raise ValueError("ts must be a timestamp with time zone")
    return bars


def check(bars: DataFrame, requested: DataFrame | None = None, limits: Thresholds = Thresholds()) -> DataFrame:
    """(symbol, check, severity, message, context) of ``bars(symbol, ts, close, adj_factor)``.

    A symbol (of ``requested``, if given, also one without any bar) with fewer than ``min_bars`` bars has that one error
    and no other issue. A run of equal closes is one issue, at the end of the series too.
    """
    exact = bars.select("symbol", F.col("ts").cast("date").alias("ts"), F.col("close").cast("decimal(18,6)").alias("close"), F.col("adj_factor").cast("decimal(10,6)").alias("adj_factor"))
    key = Window.partitionBy("symbol")
    by_time = key.orderBy("ts")
    paired = exact.withColumns({
        "n": F.count("*").over(key), "was": F.lag("ts").over(by_time), "before": F.lag("close").over(by_time), "factor": F.lag("adj_factor").over(by_time),
    }).where(F.col("n") >= limits.min_bars)
    gap = weekdays_before(F.col("ts")) - weekdays_before(F.date_add("was", 1))
    move, ratio = F.abs(F.col("close") - F.col("before")), F.col("adj_factor")
    times = lambda x: F.lit(x).cast(DecimalType(10, 6))
    pairs = paired.withColumn("gap", gap).select("symbol", F.explode(F.array_compact(F.array(
        F.when(F.col("gap") > 0, _issue("missing_bars", "warning", F.lit("trading days may be missing"), after=F.col("was"), before=F.col("ts"), missing=F.col("gap"))),
        F.when(move > F.col("before") * times(limits.move), _issue("price_anomaly", "warning", F.lit("a move that may be an error"), at=F.col("ts"))),
        F.when((ratio < F.col("factor") * times(limits.factor_low)) | (ratio > F.col("factor") * times(limits.factor_high)),
            _issue("split_dividend_consistency", "warning", F.lit("the adjustment factor jumps"), at=F.col("ts"))),
    ))).alias("issue"))
    changed = F.when(F.col("close") == F.col("before"), 0).otherwise(1)
    runs = paired.withColumn("run", F.sum(changed).over(by_time.rowsBetween(Window.unboundedPreceding, 0))).groupBy("symbol", "run").agg(F.count("*").alias("length"))
    stale = runs.where(F.col("length") >= limits.repeats).select("symbol", _issue("stale_data", "warning", F.lit("the close may be stale"), run=F.col("length")).alias("issue"))
    sizes = exact.groupBy("symbol").agg(F.count("*").alias("n"))
    if requested is not None:
        sizes = requested.select("symbol").distinct().join(sizes, "symbol", "full").withColumn("n", F.coalesce("n", F.lit(0)))
    short = F.col("n") < limits.min_bars
    general = F.when(short, _issue("insufficient_data", "error", F.lit("too few bars to be used"), count=F.col("n")))
    if limits.survivorship:
        general = general.otherwise(_issue("survivorship_risk", "info", F.lit("the universe may leave out delisted symbols")))
    whole = sizes.select("symbol", general.alias("issue")).where("issue IS NOT NULL")
    return pairs.unionByName(stale).unionByName(whole).select("symbol", "issue.*")


def report(issues: DataFrame) -> DataFrame:
    """(symbol, passed, n_errors, n_warnings, n_infos): passed is to have no error."""
    count = lambda s: F.count(F.when(F.col("severity") == s, 1))
    return issues.groupBy("symbol").agg((count("error") == 0).alias("passed"), count("error").alias("n_errors"), count("warning").alias("n_warnings"), count("info").alias("n_infos"))


def gated(bars: DataFrame, reports: DataFrame) -> DataFrame:
    """The bars that may be stored: those of symbols whose report passed."""
    return bars.join(reports.where("passed").select("symbol"), "symbol", "left_semi")


def normalized(raw: DataFrame) -> DataFrame:
    """Adjusted bars of ``raw(symbol, ts, open, high, low, close, adj_close, volume)``, as decimals of six digits, halves to even.

    The factor is adj_close / close; open, high and low are scaled by it and high and low widened to hold the body. A close
    that is not positive is an error.
    """
    six = lambda x: F.bround(x, 6).cast("decimal(18,6)")
    wide = DecimalType(20, 10)
    sound = raw.withColumns({c: F.col(c).cast(wide) for c in ("open", "high", "low", "close", "adj_close")}).withColumn(
        "close", F.when(F.col("close") > 0, F.col("close")).otherwise(F.raise_error(F.lit("close must be positive")).cast(wide))
    )
    scaled = sound.withColumn("adj_factor", six(F.col("adj_close") / F.col("close")).cast("decimal(10,6)"))
    scaled = scaled.withColumns({c: six(F.col(c) * F.col("adj_factor")) for c in ("open", "high", "low")}).withColumn("close", six(F.col("adj_close")))
    return scaled.select("symbol", "ts", "open", F.greatest("high", "open", "close").alias("high"), F.least("low", "open", "close").alias("low"), "close", "volume", "adj_factor")


# The driver's tables: daily bars of parts, split before 1998.

_SPLIT = "CASE WHEN ts < DATE '1998-01-01' THEN 0.371122 ELSE 1.0 END"


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, close, adj_factor): a part's largest quantity of a day, in tens, as close; by symbol, in tasks of a bounded size."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.format_string("P%07d", "l_partkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("ts"), "l_quantity").repartition(tasks_of(line), "symbol")
    return rows.groupBy("symbol", "ts").agg(F.ceil(F.max("l_quantity") / 10).cast("double").alias("close")).withColumn("adj_factor", F.expr(_SPLIT))


def requested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, and the nations, which have no bars; by symbol, as the bars are."""
    parts = table(spark, sf_dir, "part").select(F.format_string("P%07d", "p_partkey").alias("symbol"))
    both = parts.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol")))
    return both.repartition(tasks_of(table(spark, sf_dir, "lineitem")), "symbol")


def vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = ohlcv(table(spark, sf_dir, "lineitem"), "format_string('P%07d', l_partkey)", "CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2))")
    return bars.withColumn("adj_close", F.expr(f"close * CAST({_SPLIT} AS DECIMAL(10, 6))"))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(part_bars(spark, sf_dir), requested_symbols(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    context = lambda: F.array_join(F.array_sort(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), " ").alias("context")
    of = lambda name: lambda s, d: _issues(s, d).where(F.col("check") == name).select("symbol", context())
    text = lambda *names: [F.col(n).cast("string").alias(n) for n in names]
    return {
        "dq_issues": lambda s, d: _issues(s, d).select("symbol", "check", "severity", context()),
        "dq_stale_runs": of("stale_data"),
        "dq_split": of("split_dividend_consistency"),
        "dq_report": lambda s, d: report(_issues(s, d)),
        "gated_store": lambda s, d: gated(part_bars(s, d), report(_issues(s, d))).select("symbol", F.col("ts").cast("string").alias("ts"), "close"),
        "normalize_ohlcv": lambda s, d: normalized(vendor_bars(s, d)).select("symbol", *text("ts", "open", "high", "low", "close", "adj_factor")),
    }


def oracle_sql() -> dict[str, str]:
    base = """WITH b AS (SELECT 'P' || lpad(l_partkey::VARCHAR, 7, '0') AS symbol, CAST(l_shipdate AS DATE) AS ts, ceil(max(l_quantity) / 10) AS close,
            CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-01-01' THEN 371122 ELSE 1000000 END AS f FROM lineitem GROUP BY ALL),
        s AS (SELECT 'P' || lpad(p_partkey::VARCHAR, 7, '0') AS symbol FROM part UNION SELECT n_name FROM nation UNION SELECT symbol FROM b),
        c AS (SELECT s.symbol, count(b.ts) AS n FROM s LEFT JOIN b USING (symbol) GROUP BY s.symbol),
        p AS (SELECT b.*, lag(ts) OVER w AS pts, lag(close) OVER w AS pc, lag(f) OVER w AS pf FROM b JOIN c USING (symbol) WHERE n >= 2 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        m AS (SELECT symbol, pts, ts, (SELECT count(*) FROM range(1, CAST(ts - pts AS BIGINT)) r(k) WHERE isodow(pts + CAST(k AS INT)) < 6) AS missing FROM p WHERE pts IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - row_number() OVER (PARTITION BY symbol, close ORDER BY ts) AS island FROM p),
        i AS (SELECT symbol, 'missing_bars' AS "check", 'warning' AS severity, 'after=' || pts || ' before=' || ts || ' missing=' || missing AS context FROM m WHERE missing > 0
            UNION ALL SELECT symbol, 'price_anomaly', 'warning', 'at=' || ts FROM p WHERE 5 * abs(close - pc) > pc
            UNION ALL SELECT symbol, 'split_dividend_consistency', 'warning', 'at=' || ts FROM p WHERE 2 * f < pf OR f > 2 * pf
            UNION ALL SELECT symbol, 'stale_data', 'warning', 'run=' || count(*) FROM r GROUP BY symbol, close, island HAVING count(*) >= 5
            UNION ALL SELECT symbol, 'insufficient_data', 'error', 'count=' || n FROM c WHERE n < 2
            UNION ALL SELECT symbol, 'survivorship_risk', 'info', '' FROM c WHERE n >= 2) """
    half_even = lambda v: f"(({v}) // 100 + CASE WHEN ({v}) % 100 > 50 OR (({v}) % 100 = 50 AND ({v}) // 100 % 2 = 1) THEN 1 ELSE 0 END)"
    six = lambda v: f"CAST(CAST({v} AS DECIMAL(18, 0)) / 1000000 AS DECIMAL(18, 6))::VARCHAR"
    order = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
    return {
        "dq_issues": base + 'SELECT symbol, "check", severity, context FROM i',
        "dq_stale_runs": base + "SELECT symbol, context FROM i WHERE \"check\" = 'stale_data'",
        "dq_split": base + "SELECT symbol, context FROM i WHERE \"check\" = 'split_dividend_consistency'",
        "dq_report": base + "SELECT symbol, count(*) FILTER (severity = 'error') = 0 AS passed, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings, count(*) FILTER (severity = 'info') AS n_infos FROM i GROUP BY symbol",
        "gated_store": base + "SELECT symbol, ts::VARCHAR AS ts, close FROM b WHERE symbol IN (SELECT symbol FROM c WHERE n >= 2)",
        "normalize_ohlcv": f"""WITH t AS (SELECT *, 'P' || lpad(l_partkey::VARCHAR, 7, '0') AS symbol, CAST(l_shipdate AS DATE) AS ts, CAST(round(l_extendedprice * 100) AS BIGINT) AS px FROM lineitem),
            d AS (SELECT symbol, ts, first(px ORDER BY {order}) AS o, max(px) AS h, min(px) AS l, last(px ORDER BY {order}) AS c, CASE WHEN ts < DATE '1998-01-01' THEN 371122 ELSE 1000000 END AS f FROM t GROUP BY symbol, ts),
            x AS (SELECT symbol, ts, f, {half_even('o * f')} AS o, {half_even('h * f')} AS h, {half_even('l * f')} AS l, {half_even('c * f')} AS c FROM d)
            SELECT symbol, ts::VARCHAR AS ts, {six('o')} AS open, {six('greatest(h, o, c)')} AS high, {six('least(l, o, c)')} AS low, {six('c')} AS close, {six('f')} AS adj_factor FROM x""",
    }
