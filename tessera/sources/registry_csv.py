"""Registry CSV files: header contract, lossless cells, ragged rows told apart, quotes checked."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.identity import postal_code, province_code
from tessera.functions.text import clean
from tessera.operators import changes
from tessera.sources import csv_ranges
from tessera.sources.csv_ranges import SourceError

# The source's columns and the fields that they become.
COLUMNS = {
    "Corporation number": "source_id",
    "Business number (BN)": "business_number",
    "Corporate name - form 1": "legal_name",
    "Corporate name - form 2": "alternate_name",
    "Governing legislation": "governing_legislation",
    "Status": "status",
    "Status Detail": "status_detail",
    "Anniversary date": "anniversary_date",
    "Year of last annual filing": "last_annual_filing_year",
    "Date of last annual meeting": "last_annual_meeting_date",
    "Street": "street",
    "Street 2": "street_2",
    "City/town": "city",
    "Province/territory": "province",
    "Country": "country",
    "Postal code": "postal_code",
    "Minimum number of directors": "min_directors",
    "Maximum number of directors": "max_directors",
}
MOST_ISSUES = 10


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The file's header, trimmed; raises unless it names the 18 columns once each, in any order."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise SourceError("the file is empty")
    header = [h.strip() for h in next(csv.reader([first[0][0].lstrip("﻿")]))]
    if sorted(header) != sorted(COLUMNS):
        raise SourceError("the header doesn't name the registry's 18 columns once each")
    return header


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows as text cells in file order, with ordinal (from 1) and ragged (a row with more or fewer cells).

    Quoted cells may span lines, and a file is read in ranges all the same. Raises if a quote is never closed: a
    well-formed file has an even number of them.
    """
    header = header_of(spark, path)
    rows = csv_ranges.records(spark, path).filter("NOT heads").withColumn("ordinal", F.col("ordinal") - 1)
    cells = [F.regexp_replace(f"`{h}`", "^\\x{FEFF}", "").alias(h) for h in header]
    return csv_ranges.cells(rows, header).select("ordinal", "ragged", *cells)


def _cell(name: str) -> Column:
    return F.col(f"`{name}`")


def normalise(rows: DataFrame) -> DataFrame:
    """The registry's fields: cleaned text, nothing cast, with province and postal code also as they came, and raw_data,
    the cells as JSON in the order of the file."""
    header = [c for c in rows.columns if c in COLUMNS]
    own = {new: clean(_cell(old)) for old, new in COLUMNS.items() if new not in ("province", "postal_code")}
    return rows.select(
        "ordinal",
        "ragged",
        *(c.alias(n) for n, c in own.items()),
        F.nullif(_cell("Province/territory"), F.lit("")).alias("province_raw"),
        province_code(_cell("Province/territory")).alias("province_normalized"),
        F.nullif(_cell("Postal code"), F.lit("")).alias("postal_code_raw"),
        postal_code(_cell("Postal code")).alias("postal_code_normalized"),
        F.to_json(F.struct(*(_cell(h).alias(h) for h in header)), {"ignoreNullFields": "false"}).alias("raw_data"),
    )


def judge(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Normalised rows with action: invalid (ragged, or no id), duplicate (the id came earlier), insert, update or skip."""
    valid = ~F.col("ragged") & F.col("source_id").isNotNull()
    marked = rows.withColumn("_valid", valid)
    # rows without an id are no group of one key
    first = changes.first_wins(marked.filter("_valid"), ["source_id"], ["ordinal"]).unionByName(marked.filter("not _valid").withColumn("rn", F.lit(1)))
    known = changes.classify(first, stored, "source_id", "raw_data") if stored is not None else first.withColumn("action", F.lit("insert"))
    return known.withColumn("action", F.when(~F.col("_valid"), "invalid").when(F.col("rn") > 1, "duplicate").otherwise(F.col("action"))).drop("_valid", "rn")


def issues(judged: DataFrame, most: int = MOST_ISSUES) -> list[str]:
    """What is wrong with the first invalid rows."""
    rows = judged.filter("action = 'invalid'").orderBy("ordinal").select("ordinal", "ragged").limit(most).collect()
    return [f"row {o}: " + ("another number of cells than the header" if r else "no corporation number") for o, r in rows]


def import_file(spark: SparkSession, path: str, stored: DataFrame | None, now: str) -> tuple[DataFrame, dict]:
    """(the new snapshot, the report). The snapshot keeps ids and first import times; new rows get the next ids."""
    judged = judge(normalise(read(spark, path)), stored).persist()
    try:
        report = changes.import_report(judged).first().asDict()
        if not report["processed"]:
            raise SourceError("the file has a header and no rows")
        if report["processed"] == report["invalid"]:
            raise SourceError("no row has a corporation number")
        report["issues"] = issues(judged)
        fields = [c for c in judged.columns if c not in ("ordinal", "ragged", "action")]
        after = 0 if stored is None else stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        new = changes.new_ids(judged.filter("action = 'insert'").select("ordinal", *fields), ["ordinal"], after).drop("ordinal").withColumns({"imported_at": F.lit(now), "updated_at": F.lit(now)})
        if stored is None:
            return new.select("id", *fields, "imported_at", "updated_at"), report
        changed = judged.filter("action = 'update'").select(*fields).withColumn("updated_at", F.lit(now))
        return changes.upsert(stored, changed, ["source_id"]).unionByName(new.select(*stored.columns)), report
    finally:
        judged.unpersist()
