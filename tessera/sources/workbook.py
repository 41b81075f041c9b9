"""Workbooks of importer listings as a Spark data source, and the adapter contract of bulk evidence.

XLSX files are read as what they are, XML in a zip. The binary kinds (XLSB, XLS) are refused with a clear
message: they need a parser of their own and bring nothing that Spark could do.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.matching import source_identity
from tessera.operators.evidence import Signal

# The listing's sheet, headers and year.
SHEET, YEAR = "pQRY003_CITY", "2024"
HEADERS = ("CITY-VILLE", "COMPANY-ENTREPRISE", "PROVINCE_ENG", "PROVINCE_FRA", "POSTAL_CODE-CODE_POSTAL", "DATA_YEAR-ANNÉE_DES_DONNÉES")
MOST_BYTES, MOST_ROWS = 20 << 20, 100_000
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
ROWS = "row_number int, cells array<string>, kinds array<string>"


def sheet_rows(content: bytes, sheet: str = SHEET) -> list[tuple[int, list[str | None], list[str]]]:
    """(row number from 1, cells, kinds) of the only sheet; a kind is s (text), n (number) or empty."""
    if not content.startswith(b"PK"):
        raise ValueError("not an XLSX workbook")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "xl/workbook.xml" not in names:
            raise ValueError("not an XLSX workbook")
        sheets = ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
        if [s.get("name") for s in sheets] != [sheet]:
            raise ValueError(f"the workbook has to hold the sheet {sheet} and no other")
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        target = links[sheets[0].get(f"{{{_NS['r']}}}id")].lstrip("/")
        data = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    out = []
    for row in data.iterfind("m:sheetData/m:row", _NS):
        n, cells, kinds = int(row.get("r")), [None] * len(HEADERS), [""] * len(HEADERS)
        for c in row.findall("m:c", _NS):
            letters = re.match("[A-Z]+", c.get("r"))[0]
            at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1
            if c.find("m:f", _NS) is not None or c.get("t") == "e":
                raise ValueError(f"row {n} has a formula or an error in it")
            value, kind = c.find("m:v", _NS), c.get("t", "n")
            text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            if text is None or text == "":
                continue
            if at >= len(HEADERS):
                raise ValueError("the sheet has more than six columns")
            cells[at], kinds[at] = text, "n" if kind == "n" else "s"
        out.append((n, cells, kinds))
    return out


def listing(content: bytes) -> list[tuple[int, list[str | None]]]:
    """(row number, cells) of a listing's rows, blank ones passed over; raises for what breaks its contract."""
    if len(content) > MOST_BYTES:
        raise ValueError(f"a workbook is larger than {MOST_BYTES} bytes")
    rows = sheet_rows(content)
    if not rows or rows[0][0] != 1 or tuple(rows[0][1]) != HEADERS:
        raise ValueError("the sheet doesn't begin with the six headers")
    if len(rows) > MOST_ROWS + 1:
        raise ValueError(f"the sheet has more than {MOST_ROWS} rows")
    body = [r for r in rows[1:] if any(c is not None for c in r[1])]
    for n, cells, kinds in body:
        if "n" in kinds[:5] or not (cells[1] or "").strip() or re.sub(r"\.0+$", "", cells[5] or "") != YEAR:
            raise ValueError(f"row {n} lacks text fields, a company name or the year {YEAR}")
    return [(n, cells) for n, cells, _ in body]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Listings of the workbooks under path: row_number and one column for each header; blank rows are passed over.

    A workbook is read by one task: it is bounded by MOST_BYTES and MOST_ROWS, and the source has no larger ones. It is
    read by Spark's own file source, so from wherever Spark reads; WorkbookSource is the same as a named format.
    """
    files = spark.read.format("binaryFile").load(path)
    if files.filter(F.col("length") > MOST_BYTES).limit(1).count():
        raise ValueError(f"a workbook is larger than {MOST_BYTES} bytes")

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                body = listing(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in body], pa.int32()), pa.array([r[1] for r in body], pa.list_(pa.string()))], names=["row_number", "cells"])

    rows = files.select("content").mapInArrow(parse, "row_number int, cells array<string>")
    return rows.select("row_number", *(F.col("cells")[k].alias(h) for k, h in enumerate(HEADERS)))


class Workbook(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WorkbookReader(DataSourceReader):
    """A partition a workbook. Filters aren't pushed: Spark 4.1 keeps a reader with its pushed filters for other queries
    of the same DataFrame, which then lack rows. The option `only`, file names with commas between, chooses files."""

    def __init__(self, options):
        self.folder, self.only = options["path"], {n.strip() for n in options.get("only", "").split(",") if n.strip()}

    def partitions(self):
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        found = system.get_file_info(top)
        files = [found.path] if found.is_file else sorted(x.path for x in system.get_file_info(fs.FileSelector(top, recursive=True)) if x.is_file and x.extension.lower() == "xlsx")
        return [Workbook(p) for p in files if not self.only or p.rpartition("/")[2] in self.only]

    def read(self, partition):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        with system.open_input_file(partition.path) as f:
            for n, cells in listing(f.read(MOST_BYTES + 1)):
                yield (partition.path, n, *cells)


class WorkbookSource(DataSource):
    """spark.read.format("importer_workbook").load(folder), once register(spark) was called: path, row_number and a
    column for each header. Paths are those of the file system, without its scheme."""

    @classmethod
    def name(cls) -> str:
        return "importer_workbook"

    def schema(self) -> str:
        return "path string, row_number int, " + ", ".join(f"`{h}` string" for h in HEADERS)

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


class Adapter(NamedTuple):
    """A source of bulk evidence: its name and version, how to read rows of the common shape, and its signals."""

    source: str
    version: str
    read: Callable[[SparkSession, str], DataFrame]
    signals: tuple[Signal, ...]


#: What an adapter's rows have: key and name, identity, row number, raw JSON, attributes JSON, time.
ROW = ("source_key", "name", "city", "province", "country", "postal", "source_row_number", "raw", "attributes", "observed_at")


def identity_key(*names: str):
    """A key from the normalised identity, whatever the order of rows or the file's name."""
    own = source_identity(*names)
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in own.items()))), 256)


def _importers(spark: SparkSession, path: str) -> DataFrame:
    rows = read_workbook(spark, path)
    named = rows.select(F.col(HEADERS[1]).alias("name"), F.col(HEADERS[0]).alias("city"), F.col(HEADERS[2]).alias("province"), F.lit(None).cast("string").alias("country"), F.col(HEADERS[4]).alias("postal"), F.col("row_number").alias("source_row_number"), F.to_json(F.struct(*(F.col(h) for h in HEADERS))).alias("raw"), F.lit('{"data_year":2024}').alias("attributes"), F.lit(None).cast("string").alias("observed_at"))
    return named.withColumn("source_key", identity_key("name", "city", "province", "country", "postal")).select(*ROW)


def _json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} {'bigint' if c == 'source_row_number' else 'string'}" for c in ROW)).json(path)


IMPORTERS = Adapter("canadian-importers-2024", "city-listing-1", _importers, (Signal("is_importer", "presence"),))


def json_lines(source: str, version: str, signals: tuple[Signal, ...]) -> Adapter:
    return Adapter(source, version, _json_lines, signals)
