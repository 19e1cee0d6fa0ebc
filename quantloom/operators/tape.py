"""The whole market's trades as one series: its equity, drawdown and a recursive average by year, in as many tasks as it has chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.long_series import chunked, recursive_average, wealth
from quantloom.sources.bars import table, tasks_of

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ALPHA, SEEN = 2 / 51, 1200
#: Order keys of a bucket of a day: a larger market has more of them a day.
KEYS = 1 << 20


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, i, chunk, year, net, growth) of all line items in the order of their shipping; the discount over its mean is what a trade earns, in basis points."""
    symbol = F.when(F.col("l_shipdate").isNotNull(), "tape")  # a constant would be dropped from the windows' keys, and the rows dealt again
    rows = table(spark, sf_dir, "lineitem").select(symbol.alias("symbol"), *ORDER, ((F.col("l_discount") - 0.05) / 100).alias("net"))
    day = F.col("l_shipdate").cast("date")
    bucket = F.struct(day.alias("day"), F.floor(F.col("l_orderkey") / KEYS).alias("keys"))
    return chunked(rows, ORDER, bucket, tasks=_tasks(spark, sf_dir)).select("symbol", "i", "chunk", F.year(day).alias("year"), "net", (1 + F.col("net")).alias("growth"))


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_of(table(spark, sf_dir, "lineitem"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
        return wealth(tape(spark, sf_dir), "growth", _tasks(spark, sf_dir)).groupBy("year").agg(
            F.count("*").alias("n"), F.round(F.max_by("equity", "i"), 6).alias("equity"), F.round(F.max_by("peak", "i"), 6).alias("peak"), F.round(F.min("drawdown"), 6).alias("worst")
        )

    def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
        return recursive_average(tape(spark, sf_dir), "net", ALPHA, "average", tasks=_tasks(spark, sf_dir)).groupBy("year").agg(F.max("i").alias("last"), F.round(F.max_by("average", "i") * 1e4, 6).alias("average"))

    return {"tape_drawdown": by_year, "tape_average": averages}


def oracle_sql() -> dict[str, str]:
    """Running products over the whole tape; averages as weighted sums of the last rows, beyond which weights are below a double's last digit."""
    rows = f"(SELECT row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS i, year(CAST(l_shipdate AS DATE)) AS year, (l_discount - 0.05) / 100 AS net FROM lineitem)"
    curve = f"SELECT *, product(1 + net) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS equity FROM {rows}"
    return {
        "tape_drawdown": f"""SELECT CAST(year AS INT) AS year, count(*) AS n, round(arg_max(equity, i), 6) AS equity, round(arg_max(peak, i), 6) AS peak, round(min(equity / peak - 1), 6) AS worst
            FROM (SELECT *, max(equity) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS peak FROM ({curve})) GROUP BY year""",
        "tape_average": f"""WITH r AS MATERIALIZED {rows}, e AS (SELECT CAST(year AS INT) AS year, max(i) AS last FROM r GROUP BY year)
            SELECT e.year, e.last, round(1e4 * sum(CASE WHEN r.i = 0 THEN 1.0 ELSE {ALPHA!r} END * pow({1 - ALPHA!r}, e.last - r.i) * r.net), 6) AS average FROM e JOIN r ON r.i BETWEEN e.last - {SEEN} AND e.last GROUP BY e.year, e.last""",
    }
