"""Registry files as a stream: each micro-batch is judged against the snapshot and committed by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators import changes
from tessera.operators.store import Store


BATCH, MOST_LAYERS = "_batch", 32


def current(store: Store, key: str, table: str = "accounts") -> DataFrame | None:
    """The latest row of each key: batches are layers of changed rows."""
    rows = store.read(table)
    if rows is None:
        return None
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(BATCH)))).filter("_n = 1").drop("_n", BATCH)


def commit_batch(store: Store, key: str, content: str, table: str = "accounts"):
    """A foreachBatch function: the first row of each key in a batch wins, changed rows replace stored ones.

    A batch adds a layer of its changed rows; after MOST_LAYERS of them the table is written anew. A batch that is run
    again finds its number in the manifest's state and does nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if store.manifest()["state"].get("batch", -1) >= batch_id:
            return
        numbered = batch.withColumn("ordinal", F.monotonically_increasing_id())
        first = changes.first_wins(numbered, [key], ["ordinal"]).filter("rn = 1").drop("rn", "ordinal")
        stored, layer = current(store, key, table), F.lit(batch_id).cast("long")
        if stored is None:
            store.commit({table: first.withColumn(BATCH, layer)}, {"batch": batch_id})
            return
        judged = changes.classify(first, stored, key, content).filter("action <> 'skip'").drop("action")
        if len(store.manifest()["tables"][table]) < MOST_LAYERS:
            store.commit({}, {"batch": batch_id}, {table: judged.withColumn(BATCH, layer)})
        else:
            store.commit({table: changes.upsert(stored, judged, [key]).withColumn(BATCH, layer)}, {"batch": batch_id})

    return run


def follow(spark: SparkSession, folder: str, schema: str, store: Store, key: str, content: str, checkpoint: str, files: int = 1):
    """Follow a folder of CSV files and commit `files` of them at a time; returns the streaming query."""
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files).csv(folder)
    return rows.writeStream.foreachBatch(commit_batch(store, key, content)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_ids(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, delay: str, length: str, *by: str) -> DataFrame:
    """Counts for each window of event time; late events count until the watermark passes."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
