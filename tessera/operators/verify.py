"""Verification queries: distributions, rank-exact percentiles, checksums, integrity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.store import written


def histogram(rows: DataFrame, value: str = "score") -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def thresholds(rows: DataFrame, levels: list[int], value: str = "score") -> DataFrame:
    """(threshold, n at or above it), from one aggregation."""
    one = rows.agg(*(F.count_if(F.col(value) >= t).alias(f"t{t}") for t in levels))
    return one.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n")) for t in levels))))


def percentiles(rows: DataFrame, fractions: list[float], value: str = "score") -> DataFrame:
    """(fraction, value): the element at place floor((n - 1) * (1 - fraction)) of the descending order.

    Exact without ranking rows: running counts over the histogram, whose rows are distinct values only. For values of
    which there are few, such as scores; `selected` has no such bound.
    """
    h = histogram(rows, value).withColumn("upto", F.sum("n").over(W.orderBy(F.desc(value)))).withColumn("total", F.sum("n").over(W.partitionBy()))
    wanted = h.select(value, "n", "upto", F.explode(F.array(*(F.struct(F.lit(f).alias("fraction"), F.floor((F.col("total") - 1) * F.lit(1 - f)).alias("at")) for f in fractions))).alias("w"))
    return wanted.filter((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("n"))).select(F.col("w.fraction").alias("fraction"), value)


#: Parts of a range in one round of `selected`.
PARTS = 1024


def selected(rows: DataFrame, fractions: list[float], value: str) -> list[tuple[float, object]]:
    """As `percentiles`, exact for any number of distinct numbers: rounds of counts by range narrow down to each wanted
    rank. A round is one pass that sends PARTS rows a wanted rank to the driver, and ends where a range's least and
    largest value are the same; every round cuts a range to a 1024th. Nulls don't count; NaN is the largest number."""
    v = F.col(value)
    own = rows.filter(v.isNotNull()).select(v)
    n, low, high = own.agg(F.count(F.lit(1)), F.min(v), F.max(v)).first()
    if not n:
        return []
    # rank from below within the range low..high
    open_ = {f: (n - 1 - math.floor((n - 1) * (1 - f)), low, high) for f in fractions}
    found: dict = {}
    while open_:
        for f in [f for f, (_, a, b) in open_.items() if a == b or (a != a and b != b)]:
            found[f] = open_.pop(f)[1]
        if not open_:
            break
        places = sorted({(a, b) for _, a, b in open_.values()}, key=repr)

        def part(k: int, a, b):
            x, low_, width = v.cast("double") / 2, float(a) / 2, float(b) / 2 - float(a) / 2  # halves: no overflow
            at = F.floor((x - low_) / width * PARTS) if 0 < width < math.inf else F.when(v == F.lit(a), 0).when(v < F.lit(b), 1).otherwise(2)
            at = F.when(F.isnan(x), PARTS).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(PARTS - 1)))
            return F.when(v.between(F.lit(a), F.lit(b)), F.struct(F.lit(k).alias("k"), at.cast("int").alias("part")))

        dealt = own.select(v, F.explode(F.array_compact(F.array(*(part(k, a, b) for k, (a, b) in enumerate(places))))).alias("p"))
        counts: dict = {}
        for r in dealt.groupBy("p.k", "p.part").agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("a"), F.max(v).alias("b")).orderBy("k", "part").collect():
            counts.setdefault(r.k, []).append(r)
        for f, (rank, a, b) in list(open_.items()):
            for r in counts[places.index((a, b))]:
                if rank < r.n:
                    open_[f] = (rank, r.a, r.b)
                    break
                rank -= r.n
    return [(f, found[f]) for f in fractions]


def median(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The middle value of each group, the mean of the two middle ones where it has an even number; nulls don't count."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")) for name, df in tables.items()))


def walk(rows: DataFrame, key: str, group: str) -> DataFrame:
    """One row about a complete walk in the order of the key: rows met, distinct groups, and whether each key exceeds the
    one before. Keys repeat exactly where there are more rows than keys, so no global window is needed."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("keys"), (F.count(key) == F.countDistinct(key)).alias("in_order"))


def around_rank(rows: DataFrame, rank: int, value: str = "score", key: str = "id", each_side: int = 2) -> DataFrame:
    """The rows at a place of the descending order and on both sides of it, with their places and the size of their tie.

    Only the first rank + each_side rows are ranked.
    """
    top = rows.orderBy(F.desc(value), key).limit(rank + each_side)
    placed = top.withColumn("place", F.row_number().over(W.orderBy(F.desc(value), key))).filter(F.col("place").between(rank - each_side, rank + each_side))
    placed = written(placed, "placed")  # 2 * each_side + 1 rows at most: broadcast by that bound
    tied = rows.join(F.broadcast(placed.select(value).distinct()), value, "left_semi").groupBy(value).agg(F.count(F.lit(1)).alias("tied"))
    return placed.join(tied, value)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one row has, with their count."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def excess(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many keys repeat, and how many rows too many they have."""
    return repeated(rows, key).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("excess"))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def row_hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def checksum(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: count and a checksum that doesn't depend on the order of rows or on how they are dealt out."""
    h = F.conv(F.substring(row_hash(columns or rows.columns), 1, 15), 16, 10).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("checksum"))


def presence_hash(keys: DataFrame, key: str) -> DataFrame:
    """SHA-256 over the distinct keys in order, each ended by a new line. The keys meet in one row: use it for sets
    that a row can hold; range_hash() and checksum() have no such bound."""
    return keys.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(key)), lambda x: F.concat(x.cast("string"), F.lit("\n"))), ""), 256).alias("digest"))


RANGE = 4096


def range_hash(keys: DataFrame, key: str) -> DataFrame:
    """One row: SHA-256 over the SHA-256 digests of ranges of RANGE whole numbers, in order, each ended by a new line. A
    range's digest covers its distinct keys as in presence_hash, so no row holds more than RANGE keys; the digests, a
    4096th of the keys at most, are folded in two steps of the same kind."""
    level = keys.select(F.col(key).cast("long").alias("k"), F.col(key).cast("string").alias("text")).filter("k is not null").distinct()
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("k") / RANGE).alias("k")).agg(_folded().alias("text"))
    return level.agg(_folded().alias("digest"))


def _folded() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), ""), 256)


def in_order(rows: DataFrame, key: str, batch: str) -> DataFrame:
    """Rows of a batched traversal whose key doesn't exceed the one before in their batch: none if it was a proper keyset walk."""
    return rows.withColumn("_before", F.lag(key).over(W.partitionBy(batch).orderBy("ordinal"))).filter(F.col(key) <= F.col("_before")).drop("_before")


def samples(rows: DataFrame, flags: list[str], key: str = "id", most: int = 5) -> DataFrame:
    """(flag, id): the first rows by id that have each flag."""
    flagged = rows.select(key, F.explode(F.array(*(F.when(F.col(f), F.lit(f)) for f in flags))).alias("flag")).filter("flag is not null")
    return flagged.withColumn("_n", F.row_number().over(W.partitionBy("flag").orderBy(key))).filter(F.col("_n") <= most).select("flag", key)
