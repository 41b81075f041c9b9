"""An order-statistics index: rows stored in ranges of (value downwards, key upwards), with the rows before each range.

Rank n, a page by offset and a page after a key are found by the small table of ranges, and read the range or two that
hold them, however many rows there are. The ranges are folders that are named in the reads, so a scan lists no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: Rows of a range, about.
RANGE = 100_000


class Ranks:
    """The index in a folder; `build` writes one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ranges = spark.read.parquet(f"{self.folder}/ranges")
        self.value, self.key = (c.removeprefix("first_") for c in self.ranges.columns if c.startswith("first_"))
        self.schema = spark.read.parquet(f"{self.folder}/shape").schema

    @classmethod
    def build(cls, rows: DataFrame, value: str, key: str, folder: str, size: int = RANGE) -> Ranks:
        """Store rows, of which none has a null value or key and no key repeats, in ranges of about `size` rows."""
        spark, order = rows.sparkSession, [F.desc(value), F.asc(key)]
        n = max(1, -(-rows.count() // size))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
        dealt.write.partitionBy("_range").parquet(f"{folder}/rows")
        rows.limit(0).write.parquet(f"{folder}/shape")
        found = spark.read.schema(dealt.schema).parquet(f"{folder}/rows")
        ends = F.struct((-F.col(value)).alias("v"), F.col(key).alias("k"))
        sums = found.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min(ends).alias("low"), F.max(ends).alias("high"))
        # a row a range, a hundred-thousandth of the rows
        placed = sums.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        placed.select("_range", "n", "before", (-F.col("low.v")).alias(f"first_{value}"), F.col("low.k").alias(f"first_{key}"), (-F.col("high.v")).alias("last_v"), F.col("high.k").alias("last_k")).coalesce(1).write.parquet(f"{folder}/ranges")
        return cls(spark, folder)

    def total(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _read(self, where) -> tuple[DataFrame, int]:
        """The rows of the ranges that a condition chooses, and how many come before them."""
        chosen = self.ranges.filter(where).select("_range", "before").orderBy("_range").collect()
        if not chosen:
            return self.spark.createDataFrame([], self.schema), self.total()
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/rows/_range={r}" for r, _ in chosen)), chosen[0].before

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc(self.value), self.key)

    def page(self, offset: int, limit: int) -> DataFrame:
        """`limit` rows from place `offset` (from 0) on, with their places (from 1)."""
        if offset < 0 or limit < 1:
            raise ValueError("a page starts at 0 or later and holds a row at least")
        rows, before = self._read((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
        shown = self._ordered(rows).offset(offset - before if offset > before else 0).limit(limit)
        # a page's rows
        return shown.withColumn("place", F.row_number().over(W.orderBy(F.desc(self.value), self.key)) + F.lit(offset))

    def after(self, value, key, limit: int) -> DataFrame:
        """The next `limit` rows after a value and key in the order."""
        v, k = F.lit(value), F.lit(key)
        beyond = lambda x, y: (F.col(x) < v) | ((F.col(x) == v) & (F.col(y) > k))
        first = self.ranges.filter(beyond("last_v", "last_k")).orderBy("_range").select(F.col("before") + F.col("n")).limit(1).collect()
        if not first:
            return self.spark.createDataFrame([], self.schema)
        rows, _ = self._read(beyond("last_v", "last_k") & (F.col("before") < first[0][0] + limit))
        return self._ordered(rows.filter(beyond(self.value, self.key))).limit(limit)

    def above(self, value, equal: bool = False) -> int:
        """How many rows have a larger value, or one as large."""
        v = F.lit(value)
        inside = lambda x: F.col(x) >= v if equal else F.col(x) > v
        whole = self.ranges.filter(inside("last_v")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        cut, _ = self._read(inside(f"first_{self.value}") & ~inside("last_v"))
        return whole + cut.filter(inside(self.value)).count()

    def around(self, rank: int, each_side: int = 2) -> DataFrame:
        """The rows at place `rank` and on both sides of it, with their places and how many rows have the same value."""
        low = max(rank - 1 - each_side, 0)
        rows = self.page(low, rank + each_side - low).collect()
        tied = {v: self.above(v, True) - self.above(v) for v in {r[self.value] for r in rows}}
        return self.spark.createDataFrame([(*r, tied[r[self.value]]) for r in rows], T.StructType([*self.schema, T.StructField("place", T.IntegerType()), T.StructField("tied", T.LongType())]))

