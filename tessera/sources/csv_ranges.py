"""Quoted CSV read in byte ranges: a cell may span lines, and any line may be where a range begins.

A line starts inside a quoted cell if an odd number of quotes stand before it. The first pass counts, for each range
that Spark cuts a file into, its quotes, and the records that end in it under either assumption about its start. A
running sum over these few rows tells where each range really starts, in or out of a cell, and which number its first
record has. The second pass cuts the lines into records; what a range leaves open is put together with the next
ranges' beginnings. No row of the file is shuffled but these pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.store import written

BAD, NO_VALUE = "_bad", "\u0001"
#: Characters of one record; a longer one breaks the contract, as its quotes are most likely wrong.
MOST_RECORD = 1 << 20
#: Ranges that may be broadcast (some 60 bytes each); more are joined by sorting.
MOST_RANGES = 100_000
OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "nullValue": NO_VALUE, "emptyValue": "", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


class SourceError(ValueError):
    """A file that breaks the source's contract."""


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """(file, at, n, value): the lines of a file or folder, the start of the range that holds each, and their order in it."""
    rows = spark.read.option("lineSep", separator).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")


def _ranges(batches):
    """(new range?, (file, at), values) of consecutive lines of one range; a range may have several parts."""
    last = None
    for batch in batches:
        file, at, value = (batch.column(batch.schema.get_field_index(c)) for c in ("file", "at", "value"))
        start = 0
        keys = list(zip(file.to_pylist(), at.to_pylist(), strict=True)) if batch.num_rows and (pc.count_distinct(at).as_py() > 1 or pc.count_distinct(file).as_py() > 1) else None
        while start < batch.num_rows:
            key = keys[start] if keys else (file[start].as_py(), at[start].as_py())
            stop = batch.num_rows
            if keys:
                stop = next((i for i in range(start, batch.num_rows) if keys[i] != key), stop)
            yield key != last, key, batch.slice(start, stop - start)
            last, start = key, stop


def _ends(value: pa.Array, inside: bool):
    """Quotes of the lines, and the places of those after which no cell is open."""
    quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
    odd = (np.cumsum(quotes) + inside) % 2
    return int(quotes.sum()), odd == 0


SUMS = "file string, at long, quotes long, ends_if_outside long, ends_if_inside long, size long"


def _counted(batches):
    """A row for each range: its quotes, and the records that end in it if it starts outside or inside a cell."""

    def row(key, sums):
        return pa.RecordBatch.from_pylist([dict(zip([c.split()[0] for c in SUMS.split(", ")], (*key, *sums), strict=True))], schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("at", "quotes", "ends_if_outside", "ends_if_inside", "size"))]))

    held = None
    for new, key, batch in _ranges(batches):
        if new:
            if held:
                yield row(*held)
            held = (key, [0, 0, 0, 0])
        sums = held[1]
        value = batch.column(batch.schema.get_field_index("value"))
        quotes, closed = _ends(value, bool(sums[0] % 2))
        blank = pc.less_equal(pc.binary_length(value), 1).to_numpy(zero_copy_only=False) & pc.is_in(value, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        # a blank line outside of cells is no record
        before = np.concatenate(([sums[0] % 2 == 0], closed[:-1]))
        sums[1] += int((closed & ~(blank & before)).sum())
        sums[2] += int((~closed & ~(blank & ~before)).sum())
        sums[0] += quotes
        sums[3] += len(closed)
    if held:
        yield row(*held)


def starts(rows: DataFrame) -> DataFrame:
    """(file, at, inside, first, base, open): whether each range of `lines` starts inside a cell, how many records ended
    before it and before its file, in the order of file names, and whether a cell is open at its end."""
    sums = rows.select("file", "at", "value").mapInArrow(_counted, SUMS)
    # a row a range: some thousand for a terabyte
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    by_file = sums.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    ends = F.when(F.col("inside"), F.col("ends_if_inside")).otherwise(F.col("ends_if_outside"))
    all_before = W.orderBy("file", "at").rowsBetween(W.unboundedPreceding, -1)
    placed = by_file.withColumns({"first": F.coalesce(F.sum(ends).over(all_before), F.lit(0)), "open": (F.col("inside").cast("int") + F.col("quotes")) % 2 == 1})
    return placed.select("file", "at", "inside", "first", F.min("first").over(W.partitionBy("file")).alias("base"), "open")


PIECES = "file string, at long, ordinal long, piece string, record string"


def _cut(batches, most: int = MOST_RECORD):
    """Records of the ranges, numbered: whole ones, and pieces: `head`, which ends what a range before began, `middle`,
    which ends nothing, and `tail`, which this range leaves open."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    key, inside, ordinal, held, size = None, False, 0, [], 0

    def flushed(out):
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def left():
        if not held:
            return []
        return [(*key, ordinal, "middle" if began_inside else "tail", "\n".join(held))]

    began_inside = False
    for new, k, batch in _ranges(batches):
        out = []
        if new:
            if key is not None:
                out += left()
            key, held, size = k, [], 0
            inside = began_inside = bool(batch.column(batch.schema.get_field_index("inside"))[0].as_py())
            ordinal = batch.column(batch.schema.get_field_index("first"))[0].as_py() + 1
        value = batch.column(batch.schema.get_field_index("value"))
        quotes, closed = _ends(value, inside)
        texts = value.to_pylist()
        for text, end in zip(texts, closed.tolist(), strict=True):
            if held or not end or began_inside:
                held.append(text)
                size += len(text) + 1
                if size > most:
                    raise SourceError(f"a record is longer than {most} characters")
                if not end:
                    continue
                text = "\n".join(held)
                held, size = [], 0
            if began_inside:
                out.append((*key, ordinal, "head", text))
                began_inside = False
            elif text not in ("", "\r"):
                out.append((*key, ordinal, None, text))
            else:
                continue
            ordinal += 1
        inside = bool((inside + quotes) % 2)
        yield flushed(out)
    if key is not None:
        yield flushed(left())


def records(spark: SparkSession, path: str, separator: str = "\n", most: int = MOST_RECORD) -> DataFrame:
    """(ordinal, heads, record): the records of a file or of a folder's files, numbered from 1 in the order of file names
    and bytes, without blank ones; `heads` is true of the first of each file. Raises SourceError if a quoted cell is
    never closed; a record of more than `most` characters fails the job that reads it."""
    rows = lines(spark, path, separator)
    known = written(starts(rows), "ranges")  # each pass counts once
    n, parted = known.agg(F.count(F.lit(1)), F.count_if("inside")).first()
    if known.withColumn("last", F.lead("at").over(W.partitionBy("file").orderBy("at")).isNull()).filter("last AND open").limit(1).count():
        raise SourceError("a quoted cell is never closed")
    if n <= MOST_RANGES:
        marked = rows.join(F.broadcast(known), ["file", "at"])
    else:
        marked = rows.join(known.hint("merge"), ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "n")

    def cut(batches):
        return _cut(batches, most)

    shape = ("file", "at", "value", "inside", "first")
    out = marked.select(*shape).mapInArrow(cut, PIECES).filter("piece IS NULL").select("file", "ordinal", "record")
    if parted:
        # only ranges that a cell enters or leaves; a head or middle belongs to the last tail before it
        pieces = marked.filter("inside OR open").select(*shape).mapInArrow(cut, PIECES).filter("piece IS NOT NULL")
        order = W.partitionBy("file").orderBy("at", F.col("piece") == "tail")
        owned = pieces.withColumn("owner", F.count_if(F.col("piece") == "tail").over(order))
        parts = owned.groupBy("file", "owner").agg(F.min("ordinal").alias("ordinal"), F.array_sort(F.collect_list(F.struct("at", (F.col("piece") == "tail").alias("t"), F.col("record")))).alias("parts"))
        joined = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        sound = F.when(F.length(joined) > most, F.raise_error(F.lit(f"a record is longer than {most} characters"))).otherwise(joined)
        out = out.unionByName(parts.select("file", "ordinal", sound.alias("record")))
    # a row a file
    bases = known.groupBy("file").agg(F.min("base").alias("base"))
    out = out.join(F.broadcast(bases) if n <= MOST_RANGES else bases, "file")
    return out.select("ordinal", (F.col("ordinal") == F.col("base") + 1).alias("heads"), F.regexp_replace("record", "\r\\z", "").alias("record"))


def cells(rows: DataFrame, header: list[str]) -> DataFrame:
    """ordinal, ragged (another number of cells than the header) and the cells as text, one column for each of the header."""
    parsed = rows.select("ordinal", F.from_csv("record", ", ".join(f"`{h}` STRING" for h in [*header, BAD]), OPTIONS).alias("c"))
    cell = lambda h: F.coalesce(F.col("c").getField(h), F.lit("")).alias(h)
    return parsed.select("ordinal", F.col("c").getField(BAD).isNotNull().alias("ragged"), *map(cell, header))

