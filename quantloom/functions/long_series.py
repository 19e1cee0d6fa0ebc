"""One long series in many tasks: running products, peaks, drawdowns and recursive averages as a scan of two levels.

The windows of the other modules take a symbol's bars to one task. Here a series is cut into chunks of rows, each of which is
summed up by itself; the few summaries of a series are combined in order, and what comes before a chunk is carried back into it. Rows
are exchanged by chunk, so a single series of any length is spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.plans.engine import Ewm, with_ewms

ROWS = 4096


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` in so many tasks by key; without a number, in as many as the session exchanges by."""
    return rows.repartition(tasks, *keys) if tasks else rows


def chunked(series: DataFrame, order: list[str], bucket: Column, rows: int = ROWS, tasks: int | None = None) -> DataFrame:
    """``series(symbol, ...)`` plus i, a row's number within its symbol from 0, and chunk.

    ``order`` must be unique within a symbol, and ``bucket`` not decrease along it (a day, say): rows are numbered within buckets, and buckets
    by the counts of those before. A bucket is in one task, so buckets should become more, not longer, as a series grows.
    """
    cut = series.withColumn("_bucket", bucket)
    counts = cut.groupBy("symbol", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("symbol", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("symbol", "_bucket").orderBy(*order)) - 1
    numbered = dealt(cut, tasks, "symbol", "_bucket").withColumn("_nth", nth).join(F.broadcast(starts), ["symbol", "_bucket"]).withColumn("i", F.col("_start") + F.col("_nth"))
    return numbered.withColumn("chunk", F.expr(f"i div {rows}")).drop("_bucket", "_nth", "_start")


def wealth(chunks: DataFrame, growth: str, tasks: int | None = None) -> DataFrame:
    """``chunks`` (of ``chunked``) plus equity, the product of a growth column up to the row, its peak so far, and the drawdown from that."""
    upto = Window.partitionBy("symbol", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt(chunks, tasks, "symbol", "chunk").withColumn("_own", F.product(growth).over(upto)).withColumn("_top", F.max("_own").over(upto))
    ends = local.groupBy("symbol", "chunk").agg(F.max_by("_own", "i").alias("_all"), F.max("_own").alias("_most"))
    before = Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.coalesce(F.product("_all").over(before), F.lit(1.0)))
    carried = carried.select("symbol", "chunk", "_before", F.max(F.col("_before") * F.col("_most")).over(before).alias("_peak"))
    both = local.join(carried, ["symbol", "chunk"])
    both = both.withColumns({"equity": F.col("_before") * F.col("_own"), "peak": F.greatest("_peak", F.col("_before") * F.col("_top"))})
    return both.withColumn("drawdown", F.col("equity") / F.col("peak") - 1).drop("_own", "_top", "_before", "_peak")


def recursive_average(chunks: DataFrame, x: str, alpha: float, name: str, rows: int = ROWS, tasks: int | None = None) -> DataFrame:
    """``chunks`` (of so many rows) plus y = (1 - alpha) y' + alpha x, from the first x on; x has no nulls.

    A chunk's own average starts at its first x instead of the last y; that difference fades by (1 - alpha) a row, and over a
    whole chunk by the same factor everywhere, so the ends of the chunks are a recursive average themselves. What is carried back, a row a
    chunk, is broadcast: the rows are exchanged once, to their chunks.
    """
    aside = {"_series": F.col("symbol"), **({"_ts": F.col("ts")} if "ts" in chunks.columns else {})}
    alone = chunks.withColumns({**aside, "symbol": F.struct("symbol", "chunk"), "ts": F.col("i")})
    local = with_ewms(dealt(alone, tasks, "symbol"), {"_own": Ewm(x, alpha)}).withColumn("symbol", F.col("_series")).drop("_series", "ts").withColumnsRenamed({"_ts": "ts"})
    faded = (1 - alpha) ** rows
    ends = local.groupBy("symbol", "chunk").agg(F.max_by("_own", "i").alias("_end"), F.min_by(x, "i").alias("_first"))
    ends = ends.withColumns({"ts": F.col("chunk"), "_part": F.when(F.col("chunk") == 0, F.col("_end")).otherwise((F.col("_end") - faded * F.col("_first")) / (1 - faded))})
    whole = with_ewms(ends, {"_whole": Ewm("_part", 1 - faded)})
    last = F.lag("_whole").over(Window.partitionBy("symbol").orderBy("chunk"))
    carried = whole.select("symbol", "chunk", (last - F.col("_first")).alias("_off"))
    moved = F.coalesce("_off", F.lit(0.0)) * F.pow(F.lit(1 - alpha), F.col("i") - F.col("chunk") * rows + 1)
    return local.join(F.broadcast(carried), ["symbol", "chunk"]).withColumn(name, F.col("_own") + moved).drop("_own", "_off")
