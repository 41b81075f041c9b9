"""A hash tree over ranges of whole-number keys: stored levels of digests, and a diff of two versions that descends only
where they differ.

A leaf covers LEAF keys, an inner node FAN nodes of the level below. A digest is a count and two sums of row hashes, so
it doesn't depend on the order of rows, is combined before rows are shuffled, and a parent's is the sum of its
children's. The rows lie in the order of their keys, and the few ranges that differ are read as ranges of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.store import written
from tessera.operators.verify import row_hash

LEAF, FAN = 4096, 64
#: Ranges that are asked of the scan one by one; more are told apart by a join.
MOST_RANGES = 500
NODE = ["n", "a", "b"]


def leaves(rows: DataFrame, key: str, leaf: int = LEAF, columns: list[str] | None = None) -> DataFrame:
    """(node, n, a, b): the digest of each range of keys that has rows; rows without a key are under node null."""
    h = row_hash(columns or rows.columns)
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(38,0)")
    dealt = rows.select(F.floor(F.col(key) / leaf).cast("long").alias("node"), half(1).alias("a"), half(16).alias("b"))
    return dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))


def above(level: DataFrame, fan: int = FAN) -> DataFrame:
    """The level above one."""
    return level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.sum("n").alias("n"), F.sum("a").cast("decimal(38,0)").alias("a"), F.sum("b").cast("decimal(38,0)").alias("b"))


def root(rows: DataFrame, key: str, columns: list[str] | None = None) -> str:
    """One digest of all rows."""
    n, a, b = leaves(rows, key, 1 << 40, columns).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return f"{n}:{a}:{b}"


class HashTree:
    """A version of a table in a folder, with the levels of its tree."""

    def __init__(self, spark: SparkSession, folder: str, key: str, leaf: int = LEAF):
        self.spark, self.folder, self.key, self.leaf = spark, folder.rstrip("/"), key, leaf
        self.levels = spark.read.parquet(f"{self.folder}/levels")

    @classmethod
    def build(cls, rows: DataFrame, key: str, folder: str, leaf: int = LEAF, fan: int = FAN) -> HashTree:
        """Store rows, whose keys are whole numbers, each once, with their tree."""
        spark = rows.sparkSession
        rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{folder}/rows")
        stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
        level, all_levels = leaves(stored, key, leaf), []
        low, high = stored.agg(F.min(key), F.max(key)).first()
        reach, k = max(abs(low or 0), abs(high or 0)) // leaf + 1, 0
        while True:
            level = written(level, "level")
            all_levels.append(level.withColumn("level", F.lit(k)))
            if reach <= 1:
                break
            level, reach, k = above(level, fan), -(-reach // fan), k + 1
        reduce(DataFrame.unionByName, all_levels).repartitionByRange("level", "node").sortWithinPartitions("level", "node").write.parquet(f"{folder}/levels")
        return cls(spark, folder, key, leaf)

    def rows(self, ranges: DataFrame) -> DataFrame:
        """The rows of ranges (node) of the lowest level; a null node stands for rows without key."""
        rows, key = self.spark.read.parquet(f"{self.folder}/rows"), F.col(self.key)
        if ranges.limit(MOST_RANGES + 1).count() > MOST_RANGES:
            at = F.floor(key / self.leaf).cast("long")
            return rows.join(ranges.select(F.col("node").alias("_node")), at.eqNullSafe(F.col("_node")), "left_semi")
        wanted = [r.node for r in ranges.collect()]  # MOST_RANGES rows at most
        return rows.filter(reduce(lambda a, b: a | b, (key.isNull() if x is None else key.between(F.lit(x * self.leaf), F.lit((x + 1) * self.leaf - 1)) for x in wanted), F.lit(False)))


def different(old: HashTree, new: HashTree, fan: int = FAN) -> tuple[DataFrame, int]:
    """(node: the ranges of the lowest level whose digests differ, how many digests were compared)."""
    top = max((t.levels.agg(F.max("level")).first()[0] or 0) for t in (old, new))
    found, compared = None, 0
    for k in range(top, -1, -1):
        sides = []
        for t in (old, new):
            nodes = t.levels.filter(F.col("level") == k).select("node", *NODE)
            if found is not None:
                nodes = nodes.join(found.withColumnRenamed("node", "_up"), F.floor(F.col("node") / fan).cast("long").eqNullSafe(F.col("_up")), "left_semi")
            sides.append(nodes)
        o, n = sides[0].alias("o"), sides[1].alias("n")
        both = written(o.join(n, F.col("o.node").eqNullSafe(F.col("n.node")), "full_outer").select(F.coalesce("o.node", "n.node").alias("node"), *(F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")).alias(c) for c in NODE)), "compared")
        levels_there = all(t.levels.filter(F.col("level") == k).limit(1).count() for t in (old, new))
        compared += both.count()
        # a version that is not so tall has no node here: everything below may differ
        found = both.filter("NOT (n AND a AND b)").select("node") if levels_there else both.select("node")
    return found, compared


def changed_keys(old: HashTree, new: HashTree) -> DataFrame:
    """(key, change: created, updated or removed) of two versions, from the ranges that differ."""
    ranges = written(different(old, new)[0], "ranges")
    hashed = lambda t: t.rows(ranges).select(F.col(t.key), row_hash([f.name for f in t.spark.read.parquet(f"{t.folder}/rows").schema]).alias("h"))
    o, n = hashed(old).alias("o"), hashed(new).alias("n")
    change = F.when(F.col("o.h").isNull(), "created").when(F.col("n.h").isNull(), "removed").when(F.col("o.h") != F.col("n.h"), "updated")
    joined = o.join(n, F.col(f"o.{old.key}") == F.col(f"n.{new.key}"), "full_outer")
    return joined.select(F.coalesce(f"o.{old.key}", f"n.{new.key}").alias(old.key), change.alias("change")).filter("change IS NOT NULL")
