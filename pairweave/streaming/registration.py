"""Scores that arrive in files, put into the evaluation store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.operators.store import Store


def register_scores(spark: SparkSession, source: str, schema: str, store: Store, checkpoint: str):
    """A query over Parquet files (keys, method, score) in ``source``; scores of a later batch win, and of a pair's scores in one batch, which have no order, the greatest.

    A batch that runs again after a failure puts the same scores again, so each
    file counts once. ``trigger(availableNow)`` takes what is there and ends.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for method in [r.method for r in batch.select("method").distinct().collect()]:
            rows = batch.filter(F.col("method") == method).groupBy(*store.keys).agg(F.max("score").alias("score"))
            store.put_method(method, rows, update=True)
        batch.unpersist()

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
