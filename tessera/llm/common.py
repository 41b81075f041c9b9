"""Session, shared-folder and sizing helpers of the text operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one; on a cluster
    each machine would have its own, so there the setting is asked for."""
    path = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"{CHECKPOINT_KEY} has to name a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and read again: a lost executor costs no earlier stage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `cut` wrote for df, which nothing reads any more."""
    remove(df.sparkSession, df._cut)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Rows of a side that may be broadcast; it is counted first, and merged with the other side beyond it.
MOST_BROADCAST = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """df, written, with the hint to broadcast it if it has MOST_BROADCAST rows at most, else to merge."""
    df = cut(df, "side")
    return df.hint("broadcast" if df.count() <= MOST_BROADCAST else "merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups_for(total: int, each: int, least: int) -> int:
    """How many groups of about `each` units hold `total`; `least` keeps small inputs spread out."""
    return max(least, -(-int(total or 0) // each))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def runs(batches, keys: list[str]):
    """Arrow tables of consecutive rows with equal keys, from batches sorted by them; a run may cross batches."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            x = table[k].to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        if held and any(held[-1][k][-1].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a and held:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()
