"""Helpers shared by the operators: table access, checkpoints, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer filled partitions than the cluster has cores (a few row groups), dealt out to all of them; any other as it is.

    Only small tables are moved; a table of many files is not even counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return df
    return df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only a local session that sets none (tests) gets one here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quantloom-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder named in ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    return checkpoint(df.groupBy(keys[0]).agg(F.min(keys[1]).alias("low")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, root the smallest node reachable.

    Alternates large-star and small-star rewrites (Kiveris et al., SoCC 2014) until every
    edge points at its component's smallest node. The per-node minimum is pre-aggregated
    and written before it is joined back, so both join sides are plain exchanges and the
    adaptive skew join can split a hub. Self-loops and repeated edges are harmless;
    no edges give no rows.
    """
    edge = checkpoint(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    seen = None
    while True:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _spread(both, "u", "v")
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
            .unionByName(edge.join(low, "u").select("u", F.col("low").alias("v")))
            .where("u > v").distinct()
        )
        large = checkpoint(large)
        low = _spread(large, "u", "v")
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
            .where("u > v").distinct()
        )
        edge = checkpoint(small)
        state = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
