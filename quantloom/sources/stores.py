"""Partitioned stores: idempotent upserts, appends, retention and verified migration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(new: DataFrame, path: str, keys: list[str], partition: str = "symbol", order: str | None = None) -> None:
    """Last write wins by key; only the partitions that new rows touch are rewritten.

    Of new rows that share a key the one with the greatest ``order`` counts; without an order, or where that ties, they are an error.
    """
    spark = new.sparkSession
    if order:
        new = new.withColumn("_top", F.max(order).over(Window.partitionBy(*keys))).where(F.col(order).eqNullSafe(F.col("_top"))).drop("_top")
    if not new.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows share a key of {keys}")
    had = read(spark, path, new)
    touched = had.join(new.select(partition).distinct(), partition, "left_semi")
    both = touched.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    latest = both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_age"))).where("_k = 1").drop("_k", "_age")
    _replace(latest, path, partition)


def _replace(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrite partitions of a store by rows that may be read from it.

    The rows are written beside the store first, and read from there: were they only cached, a
    lost executor would recompute them from files that the overwrite has already replaced.
    """
    spark = rows.sparkSession
    staged = f"{path.rstrip('/')}._staged_{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append(rows: DataFrame, path: str) -> None:
    """Bars of a log, and quality reports, which are kept whether their bars passed or not."""
    rows.write.mode("append").parquet(path)


def store_gated(bars: DataFrame, reports: DataFrame, bars_path: str, reports_path: str, keys: list[str]) -> None:
    """All of ``reports(symbol, passed, ...)`` are appended; only bars of symbols that passed are stored."""
    append(reports, reports_path)
    upsert(bars.join(reports.where("passed").select("symbol").distinct(), "symbol", "left_semi").select(*bars.columns), bars_path, keys)


def retain(path: str, like: DataFrame, newest: int, by: str, graduated: str = "graduated", partition: str = "symbol") -> None:
    """Keep all graduated rows, and of the others the newest few of each partition."""
    had = read(like.sparkSession, path, like)
    w = Window.partitionBy(partition, F.coalesce(F.col(graduated), F.lit(False))).orderBy(F.desc(by))
    _replace(had.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= newest) | F.col(graduated)).drop("_k"), path, partition)


def migrate(old: DataFrame, path: str, partition: str = "symbol") -> int:
    """Write ``old`` as a partitioned store and prove that it holds the same rows, repeats included."""
    old.write.mode("errorifexists").partitionBy(partition).parquet(path)
    new = read(old.sparkSession, path, old)
    if not (old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty()):
        raise ValueError(f"{path} does not hold what was migrated")
    return new.count()


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store, empty if it does not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns) if exists else like.limit(0)
