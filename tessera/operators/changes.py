"""Incremental maintenance as joins between a stored snapshot and what comes in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.operators.store import shared_path, written


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with rn: 1 for the first of each key in the given order, more for those that repeat it."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def classify(incoming: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """incoming with action: insert for a new key, skip for equal content, else update."""
    was = stored.select(key, F.col(content).alias("_was"), F.lit(True).alias("_there"))
    joined = incoming.join(was, key, "left")
    return joined.withColumn("action", F.when(F.col("_there").isNull(), "insert").when(F.col(content).eqNullSafe(F.col("_was")), "skip").otherwise("update")).drop("_was", "_there")


def import_report(classified: DataFrame) -> DataFrame:
    """One row of counters: processed = inserted + updated + skipped + invalid; duplicates are among the skipped."""
    n = lambda a: F.count_if(F.col("action") == a).cast("long")
    return classified.agg(F.count(F.lit(1)).alias("processed"), n("insert").alias("inserted"), n("update").alias("updated"), (n("skip") + n("duplicate")).alias("skipped"), n("invalid").alias("invalid"), n("duplicate").alias("duplicates"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after incoming rows replace stored ones of their key; columns of `kept` stay as stored.

    incoming has one row a key. Columns that it lacks stay as stored, null for new rows.
    """
    have = set(incoming.columns)
    old, new = stored.alias("o"), incoming.withColumn("_new", F.lit(True)).alias("n")
    joined = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    there = reduce(lambda a, b: a | b, (F.col(f"o.{c}").isNotNull() for c in stored.columns))

    def pick(c: str) -> Column:
        if c in key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        if c not in have:
            return F.col(f"o.{c}")
        taken = F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(there, F.col(f"o.{c}")).otherwise(taken) if c in kept else taken

    return joined.select(*(pick(c).alias(c) for c in stored.columns))


def patch(stored: DataFrame, changes: DataFrame, key: list[str], provided: str = "provided") -> DataFrame:
    """The snapshot after partial changes: only fields named in the array `provided` change, an explicit null clears."""
    joined = stored.alias("o").join(changes.withColumn("_new", F.lit(True)).alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key], "full_outer")

    def pick(c: str) -> Column:
        if c in key:
            return F.coalesce(f"n.{c}", f"o.{c}")
        return F.when(F.array_contains(f"n.{provided}", c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return joined.select(*(pick(c).alias(c) for c in stored.columns))


def stale(rows: DataFrame, derived: DataFrame, key: str, version: str, updated: str = "updated_at") -> DataFrame:
    """rows whose derived row (key, version, source_updated_at) is missing, of other rules or of an older row."""
    had = derived.select(F.col(key), F.col("version").alias("_v"), F.col("source_updated_at").alias("_u"))
    joined = rows.join(had, key, "left")
    fresh = (F.col("_v") == version) & F.col("_u").eqNullSafe(F.col(updated))
    return joined.filter(~F.coalesce(fresh, F.lit(False))).select(*rows.columns)


def new_ids(rows: DataFrame, order: list[str], after: int, name: str = "id") -> DataFrame:
    """rows numbered from after + 1 on in the given order, without one global window: partitions by range, counted.

    A fixed number of partitions, written before they are counted, so that what is counted is what is numbered.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "numbered")
    rows.repartitionByRange(width, *order).withColumn("_p", F.spark_partition_id()).write.parquet(path)
    spread = spark.read.parquet(path)
    spread = spread.withColumn("_at", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    # one row a partition
    counts = spread.groupBy("_p").agg(F.max("_at").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(counts.select("_p", "_before")), "_p").withColumn(name, F.lit(after) + F.col("_before") + F.col("_at")).drop("_p", "_at", "_before")


def publish(published: DataFrame, accepted: DataFrame, key: list[str], source: str, run_id: int) -> DataFrame:
    """The observations after a run: its accepted rows replace those of their key, and rows of the same source that
    other runs left are retired; rows without run_id were entered by hand and stay. A null value deletes."""
    stays = published.filter((F.col("source") != source) | F.col("run_id").isNull() | (F.col("run_id") == run_id))
    merged = upsert(stays, accepted.withColumn("run_id", F.lit(run_id).cast(dict(published.dtypes)["run_id"])), key)
    values = [c for c in published.columns if c.startswith("value_")]
    return merged.filter(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in values)))


def diff(old: DataFrame, new: DataFrame, key: list[str], compared: list[str]) -> DataFrame:
    """(key, change, before, after) for each key of two versions: created, updated, same or removed; `before` and `after`
    are structs of the other columns of both, null where there is none. A null in the key is a value of its own."""
    packed = lambda rows: rows.select(*key, F.struct(*(c for c in rows.columns if c not in key)).alias("side"))
    o, n = packed(old).alias("o"), packed(new).alias("n")
    joined = o.join(n, reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key)), "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"o.side.{c}").eqNullSafe(F.col(f"n.side.{c}")) for c in compared), F.lit(True))
    change = F.when(F.col("o.side").isNull(), "created").when(F.col("n.side").isNull(), "removed").when(same, "same").otherwise("updated")
    return joined.select(*(F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in key), change.alias("change"), F.col("o.side").alias("before"), F.col("n.side").alias("after"))


def feed(published: DataFrame, accepted: DataFrame, key: list[str], source: str, run_id: int, now: str, after: int) -> tuple[DataFrame, DataFrame]:
    """(the observations after a run, what the run did to them: key, id, change, run_id).

    As `publish`, with the id and creation time of each observation kept for as long as its key is there; new ones get
    the ids that follow `after`. The feed has created, updated, same and removed rows; others' rows aren't in it.
    """
    values = [c for c in published.columns if c.startswith("value_")]
    given = accepted.filter(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in values)))
    moved = written(diff(published, given, key, values), "diff")
    known = set(given.columns) - set(key)
    mine = (F.col("source") == source) & F.col("before.run_id").isNotNull() & (F.col("before.run_id") != run_id)
    ids = new_ids(moved.filter("change = 'created'").select(*key), key, after, "_id").alias("i")
    m = moved.alias("m")
    placed = m.join(ids, reduce(lambda a, b: a & b, (F.col(f"m.{k}").eqNullSafe(F.col(f"i.{k}")) for k in key)), "left").select("m.*", "_id")
    kept = F.col("change") == "removed"

    def of(c: str) -> Column:
        if c in key:
            return F.col(c)
        old = F.col(f"before.{c}")
        new = {"id": F.coalesce(old, F.col("_id")), "created_at": F.when(F.col("change") == "created", F.lit(now)).otherwise(old), "updated_at": F.lit(now), "run_id": F.lit(run_id).cast("long")}.get(c)
        if new is None:
            new = F.col(f"after.{c}") if c in known else F.lit(None)
        return F.when(kept, old).otherwise(new).cast(dict(published.dtypes)[c])

    table = placed.filter(~kept | ~mine).select(*(of(c).alias(c) for c in published.columns))
    told = placed.filter(~kept | mine).select(*key, F.coalesce("before.id", "_id").alias("id"), "change", F.lit(run_id).cast("long").alias("run_id"))
    return table, told


def refreshed(stored: DataFrame, fresh: DataFrame, key: str, compared: list[str], stamp: str, now: Column) -> DataFrame:
    """fresh with changed (any compared column differs from the stored row, or there is none) and a stamp that is
    carried over where nothing changed; stored rows that fresh lacks are gone."""
    was = stored.select(F.col(key), F.lit(True).alias("_there"), F.col(stamp).alias("_stamp"), *(F.col(c).alias(f"_{c}") for c in compared))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in compared))
    joined = fresh.join(was, key, "left").withColumn("changed", ~(F.coalesce(F.col("_there"), F.lit(False)) & same))
    return joined.withColumn(stamp, F.when(F.col("changed"), now).otherwise(F.col("_stamp"))).drop("_there", "_stamp", *(f"_{c}" for c in compared))
