"""Streams into stores: idempotent ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quantloom.sources.stores import upsert


def ingest(bars: DataFrame, path: str, keys: list[str], late: str = "7 days") -> DataStreamWriter:
    """Bars of a stream into a partitioned store, each key once: repeats within the watermark are dropped, later ones overwrite.

    A batch that is replayed after a failure writes the same rows.
    """
    unique = bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return unique.writeStream.foreachBatch(lambda batch, _: upsert(batch.dropDuplicates(keys), path, keys)).outputMode("append")
