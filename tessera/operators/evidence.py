"""Bulk evidence: row contract, identity conflicts, declared signal aggregates, coverage and provenance."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KINDS = ("presence", "row_count", "distinct_count", "max_number")
NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"
MOST_ROWS_SHOWN = 25


class Signal(NamedTuple):
    """An aggregate over a source company's rows: its kind, and the attribute that it reads."""

    name: str
    kind: str
    attribute: str | None = None


def check(signal: Signal) -> Signal:
    if signal.kind not in KINDS or (signal.kind in KINDS[2:]) != (signal.attribute is not None):
        raise ValueError(f"{signal.name}: no such aggregate")
    if signal.attribute is not None and not re.fullmatch(r"[a-zA-Z][a-zA-Z0-9_]*", signal.attribute):
        raise ValueError(f"{signal.name}: no such attribute")
    return signal


def _value(attributes: Column, name: str) -> tuple[Column, Column, Column]:
    """(type, text, number) of an attribute of a variant column; null for absent, JSON null and blank values."""
    path = f"$.{name}"
    text = F.variant_get(attributes, path, "string")
    kind = F.schema_of_variant(F.try_variant_get(attributes, path, "variant"))
    family = F.when(kind.rlike(NUMERIC), F.when(kind.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "real").otherwise("integer")).otherwise(F.lower(kind))
    there = text.isNotNull() & (F.trim(text) != "")
    return F.when(there, family), F.when(there, text), F.when(there & kind.rlike(NUMERIC), F.try_variant_get(attributes, path, "double"))


def aggregate(rows: DataFrame, key: str, attributes: str, signals: list[Signal]) -> DataFrame:
    """A row for each key and a column for each signal; null where nothing was seen, never 0.

    `attributes` is a JSON text or a variant. All signals come from one aggregation. Values of distinct types
    count as distinct (2024 is not "2024"), only JSON numbers have a maximum.
    """
    column = F.col(attributes)
    if dict(rows.dtypes)[attributes] == "string":
        column = F.try_parse_json(column)
    rows = rows.withColumn("_a", column)
    out = []
    for s in map(check, signals):
        if s.kind == "presence":
            value = F.when(F.count(F.lit(1)) > 0, F.lit(True))
        elif s.kind == "row_count":
            value = F.nullif(F.count(F.lit(1)), F.lit(0).cast("long"))
        else:
            kind, text, number = _value(F.col("_a"), s.attribute)
            value = F.nullif(F.countDistinct(F.when(text.isNotNull(), F.struct(kind, text))), F.lit(0).cast("long")) if s.kind == "distinct_count" else F.max(number)
        out.append(value.alias(s.name))
    return rows.groupBy(key).agg(*out)


def in_utc(time: str) -> Column:
    """A time as text in UTC, to the millisecond; null for none. Such texts sort like the times."""
    at = F.to_utc_timestamp(F.col(time).try_cast("timestamp"), F.current_timezone())
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def check_rows(rows: DataFrame) -> None:
    """Raise for rows without key or name, with a time that can't be read, without a positive row number, or with an
    attribute that is neither text nor a finite number nor null; one aggregation."""
    c = F.col
    bad = rows.agg(
        F.count_if(F.coalesce(F.trim(c("source_key")), F.lit("")) == "").alias("key"),
        F.count_if(F.coalesce(F.trim(c("name")), F.lit("")) == "").alias("name"),
        F.count_if(c("observed_at").isNotNull() & c("observed_at").try_cast("timestamp").isNull()).alias("observed_at"),
        F.count_if(~F.coalesce(c("source_row_number") > 0, F.lit(False))).alias("source_row_number"),
        *([F.count_if(c("attributes").isNotNull() & ~F.coalesce(_scalars(c("attributes")), F.lit(False))).alias("attributes")] if "attributes" in rows.columns else []),
    ).first()
    wrong = [k for k, n in bad.asDict().items() if n]
    if wrong:
        raise ValueError(f"rows of the source lack what they must have: {', '.join(wrong)}")


def _scalars(attributes: Column) -> Column:
    """Whether a JSON text is an object of texts, numbers that a double can hold, and nulls."""
    own = F.from_json(attributes, "map<string,string>")
    shape = F.schema_of_variant(F.try_parse_json(attributes))
    number = F.forall(F.map_values(own), lambda x: x.isNull() | ~x.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?\z") | (F.abs(x.try_cast("double")) < float("inf")))
    return shape.rlike("^OBJECT") & ~F.substring(shape, 8, 1 << 20).rlike("OBJECT|ARRAY|BOOLEAN") & number


def conflicting_keys(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Source keys that stand for more than one normalised identity."""
    return rows.groupBy("source_key").agg(F.countDistinct(F.struct(*identity)).alias("n")).filter("n > 1").select("source_key")


def coverage(observations: DataFrame, rows: DataFrame, key: tuple[str, ...] = ("source_key", "run_id"), most: int = MOST_ROWS_SHOWN) -> DataFrame:
    """Observations with the first source rows of their company in their own run, by row number, as a list; those that
    belong to no run have none."""
    shown = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("source_row_number"))).filter(F.col("_n") <= most)
    lists = shown.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("source_row_number", "raw"))).alias("source_rows"))
    return observations.join(lists, list(key), "left").orderBy("source", "signal_type")


def decoded() -> Column:
    """The value of an observation: its boolean, else its number, else its text, as JSON text."""
    return F.coalesce(F.col("value_boolean").cast("string"), F.col("value_number").cast("string"), F.to_json(F.struct(F.col("value_text").alias("v"))))
