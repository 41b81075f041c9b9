"""What is asked of a file before and after a run, and of rows before they are stored."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the largest upload.
MOST_BYTES = 200 << 20


class Refused(ValueError):
    """A file that isn't taken; `kind` is one of name, missing, empty, size, content."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Identity(NamedTuple):
    name: str
    size: int
    modified: str
    sha256: str | None


def identify(spark: SparkSession, path: str, with_hash: bool = True) -> Identity:
    """Name, size, time and SHA-256 of a file, or of a folder's files in order of their paths. Executors read and hash
    each file; the driver gets a row a file."""
    files = spark.read.format("binaryFile").load(path)
    rows = files.select("path", "length", F.col("modificationTime").cast("string").alias("modified"), (F.sha2("content", 256) if with_hash else F.lit(None).cast("string")).alias("sha256")).orderBy("path").collect()
    if not rows:
        raise Refused("missing", "there is no such file")
    whole = rows[0].sha256 if len(rows) == 1 or not with_hash else spark.range(1).select(F.sha2(F.lit("".join(r.sha256 + "\n" for r in rows)), 256)).first()[0]
    return Identity(path.rstrip("/").rpartition("/")[2], sum(r.length for r in rows), max(r.modified for r in rows), whole)


def check_upload(file: Identity, allowed: Iterable[str] | None = None, most: int = MOST_BYTES) -> Identity:
    """The file, if its name, size and content are those of an upload that is taken. allowed: SHA-256 digests, None for any."""
    if not file.name.lower().endswith(".csv") or len(file.name) > 200 or file.name == ".csv":
        raise Refused("name", "choose a CSV file (.csv)")
    if not file.size:
        raise Refused("empty", "the file is empty")
    if file.size > most:
        raise Refused("size", f"the file is larger than {most >> 20} MB")
    if allowed is not None and file.sha256 not in {a.lower() for a in allowed}:
        raise Refused("content", "the file isn't one of those that are taken")
    return file


def check_unchanged(spark: SparkSession, path: str, before: Identity) -> None:
    """Raise if a file has another size or time than before the run."""
    now = identify(spark, path, with_hash=False)
    if (now.size, now.modified) != (before.size, before.modified):
        raise RuntimeError("the source file changed during the run; retry with a stable file")


def one_of(column: str, values: Iterable[str]) -> Column:
    return F.col(column).isin(*values)


def between(column: str, low: float, high: float = float("inf")) -> Column:
    return F.col(column).between(low, high)


def exactly_one(columns: Iterable[str]) -> Column:
    """Just one of the columns has a value."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns)) == 1


def check(rows: DataFrame, rules: dict[str, Column], nullable: Iterable[str] = ()) -> DataFrame:
    """The rows, if all keep the rules; raises naming those that some row breaks. One aggregation. A rule that comes out
    null is broken, unless it is named as nullable."""
    counts = rows.agg(*(F.count_if(~F.coalesce(rule, F.lit(name in set(nullable)))).alias(name) for name, rule in rules.items())).first().asDict()
    broken = {k: n for k, n in counts.items() if n}
    if broken:
        raise ValueError("rows break the rules " + ", ".join(f"{k} ({n})" for k, n in sorted(broken.items())))
    return rows
