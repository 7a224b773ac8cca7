"""Periodic refresh: classify newly landed move histories, once each.

Landed files are picked up by a file stream that runs until it has seen
everything and stops. Its checkpoint remembers the files; the anti join keeps
subjects that an earlier run already stored from being added twice, also when
a batch is replayed after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from movelens.schemas import TRANSFER_TYPES
from movelens.sources.feeds import flatten_history
from movelens.sources.tables import dedupe, read_or_empty

HISTORY_FILE = "player_id long, body string"


def refresh_types(spark: SparkSession, landed: str, store: str, checkpoint: str) -> None:
    """Append the moves of subjects not stored yet; returns when all files are done."""
    def append(batch: DataFrame, _: int) -> None:
        done = read_or_empty(spark, store, TRANSFER_TYPES).select("player_id").distinct()
        fresh = batch.join(done, "player_id", "left_anti")
        one = dedupe(fresh, ["player_id"], [F.col("body")])
        flatten_history(one).select(*TRANSFER_TYPES.fieldNames()).write.mode("append").parquet(store)

    stream = spark.readStream.schema(HISTORY_FILE).json(landed)
    query = (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
