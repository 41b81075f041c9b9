"""Registry files as a stream whose state tells new, changed and known rows: no batch reads the snapshot again.

The state of a source id is the hash of its content. A micro-batch gives the rows that are new or differ from what was
seen, the first of each id in the order of files and rows, whatever came before a restart; the rest of it ends there.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.store import Store
from tessera.sources.registry_csv import COLUMNS, SourceError

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an id is remembered that no file names any more; after that its row counts as new.
EXPIRY_MS = 400 * 24 * 3600 * 1000
NAMES = tuple(COLUMNS.values())
CELLS = "file string, ordinal long, ragged boolean, " + ", ".join(f"{n} string" for n in NAMES)
CHANGES = ", ".join(f"{n} string" for n in NAMES) + ", action string, duplicates long"


def rows_of(name: str, text: str) -> Iterator[tuple]:
    """(file, ordinal, ragged, cells in the order of NAMES) of a registry file, whatever the order of its columns; raises
    SourceError for another header or a quote that is never closed."""
    found = (r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline=""), strict=True) if r)
    try:
        header = [h.strip() for h in next(found, [])]
        if sorted(header) != sorted(COLUMNS):
            raise SourceError(f"{name}: the header doesn't name the registry's 18 columns once each")
        at = [header.index(c) for c in COLUMNS]
        for ordinal, row in enumerate(found, 1):
            ragged = len(row) != len(header)
            cells = [None] * len(at) if ragged else [row[i].strip() or None for i in at]
            yield (name, ordinal, ragged, *cells)
    except csv.Error as e:
        raise SourceError(f"{name}: {e}") from e


def _parsed(batches):
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = list(rows_of(name, text.as_py() or ""))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (3 + len(NAMES))
            kinds = [pa.string(), pa.int64(), pa.bool_(), *[pa.string()] * len(NAMES)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CELLS.split(", ")])


class Known(StatefulProcessor):
    """Keeps the content's hash of each id; yields a row that is new or changed."""

    def __init__(self, expiry_ms: int = EXPIRY_MS):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "hash string", self.expiry_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, n = None, 0
        for r in rows:
            n += 1
            if first is None or (r.file, r.ordinal) < (first.file, first.ordinal):
                first = r
        own = tuple(first[c] for c in NAMES)
        digest = hashlib.sha256(repr(own).encode()).hexdigest()
        old = self.known.get()[0] if self.known.exists() else None
        self.known.update((digest,))  # also puts its expiry off
        if old != digest:
            yield Row(**dict(zip(NAMES, own, strict=True)), action="insert" if old is None else "update", duplicates=n - 1)

    def close(self) -> None:
        pass


def changes(spark: SparkSession, folder: str, files: int = 1, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """The stream of new and changed rows (NAMES, action, duplicates: later rows of the id in its batch) of the files that
    come into a folder, `files` of them at a time. The metrics `intake` of each batch count rows, ragged ones and
    those without an id, which go no further. A file is one task's work, as it comes whole."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    whole = spark.readStream.option("maxFilesPerTrigger", files).text(folder, wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(_parsed, CELLS)
    blank = F.col("source_id").isNull()
    rows = rows.observe("intake", F.count(F.lit(1)).alias("rows"), F.count_if("ragged").alias("ragged"), F.count_if(blank & ~F.col("ragged")).alias("without_id"))
    return rows.filter(~F.col("ragged") & ~blank).groupBy("source_id").transformWithState(Known(expiry_ms), CHANGES, "Update", "ProcessingTime")


LAYER = "_batch"


def commit_changes(store: Store, table: str = "stream"):
    """A foreachBatch function that adds a batch's changes as a layer; a batch that is run again changes nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        state = f"batch_{table}"
        if store.manifest()["state"].get(state, -1) < batch_id:
            store.commit({}, {state: batch_id}, {table: batch.withColumn(LAYER, F.lit(batch_id).cast("long"))})

    return run


def current(store: Store, table: str = "stream") -> DataFrame:
    """The latest row of each id."""
    rows = store.read(table)
    last = F.max_by(F.struct(*(c for c in NAMES if c != "source_id")), LAYER).alias("row")
    return rows.groupBy("source_id").agg(last).select("source_id", "row.*")


def follow(spark: SparkSession, folder: str, store: Store, checkpoint: str, files: int = 1):
    """Commit what comes into a folder until nothing new is there; returns the streaming query. Without the setting below
    a state that can expire asks for another batch for ever, also when there is no file left."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return changes(spark, folder, files).writeStream.outputMode("update").foreachBatch(commit_changes(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
