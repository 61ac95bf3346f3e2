"""Reading and writing bitext: any Spark format, and xlsx by the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.align import row_numbers

#: Column names of the workbooks.
NAMES = {"원문": "src", "번역문": "tgt", "문단식별자": "paragraph_id", "문장식별자": "sentence_id", "구식별자": "phrase_id", "분할방법": "split_method", "유사도": "similarity"}
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def parse_xlsx(raw: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet as text, empty cells null."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(_NS + "t") if t is not None) for si in root.iter(_NS + "si")]
        sheet = "xl/worksheets/sheet1.xml"
        if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
            first = next(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_NS + "sheet"))
            targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheet = "xl/" + targets[first.get(_REL + "id")].removeprefix("/xl/")
        for row in ElementTree.fromstring(z.read(sheet)).iter(_NS + "row"):
            cells: list[str | None] = []
            for c in row.iter(_NS + "c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    at -= 1
                cells += [None] * (at + 1 - len(cells))
                value = c.find(_NS + "v")
                if c.get("t") == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(_NS + "t"))
                elif value is not None and value.text is not None:
                    cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text
            yield cells


class XlsxReader(DataSourceReader):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            rows = parse_xlsx(f.read())
        next(rows, None)
        for k, cells in enumerate(rows):
            yield (str(k), *(cells + [None] * self.width)[: self.width])


class XlsxSource(DataSource):
    """format("xlsx"): the first sheet with a header row; row_idx counts data rows from 0. A workbook holds
    at most 1,048,576 rows, so one partition reads it."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def _header(self) -> list[str]:
        with open(self.options["path"], "rb") as f:
            return [str(c) for c in next(parse_xlsx(f.read()), [])]

    def schema(self) -> StructType:
        return StructType([StructField("row_idx", StringType()), *(StructField(n, StringType()) for n in self._header())])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(self.options["path"], len(schema.fields) - 1)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """row_idx and the columns of the first sheet's header, all text, from one workbook or several of one header
    in any file system that Spark reads; a task for each workbook. Rows of several count on in the order of their paths."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"names": [[str(c) for c in next(parse_xlsx(raw), [])] for raw in batch["content"]]})

    found = files.limit(1).mapInPandas(header, "names array<string>").first()
    names = found.names if found else []

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                data = parse_xlsx(raw)
                next(data, None)
                cells = [(path, k, *(row + [None] * len(names))[: len(names)]) for k, row in enumerate(data)]
                yield pd.DataFrame(cells, columns=["_path", "_k", *names])

    schema = StructType([StructField("_path", StringType()), StructField("_k", LongType()), *(StructField(n, StringType()) for n in names)])
    out = files.mapInPandas(rows, schema)
    return row_numbers(out, ["_path", "_k"]).drop("_path", "_k")


#: Rows that a sheet holds, its header included.
SHEET_ROWS = 1_048_576


def write_xlsx(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """One sheet, inline strings, no index; rows go through the driver one partition at a time."""
    rows = (df.orderBy(*order) if order else df).toLocalIterator()

    def line(values: list, n: int) -> str:
        cells = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>" for v in values)
        return f'<row r="{n}">{cells}</row>'

    main = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData>'.encode())
            f.write(line(list(df.columns), 1).encode())
            for n, row in enumerate(rows, 2):
                if n > SHEET_ROWS:
                    raise ValueError(f"a sheet holds {SHEET_ROWS} rows; write another format")
                f.write(line(list(row), n).encode())
            f.write(b"</sheetData></worksheet>")


def require(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_bitext(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, src, tgt) from xlsx, parquet, csv, json or orc; either language's column names."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        df = read_xlsx(spark, path)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        df = spark.read.format({"jsonl": "json"}.get(kind, kind)).load(path)
    df = df.withColumnsRenamed({k: v for k, v in NAMES.items() if k in df.columns})
    require(df, "src", "tgt")
    if "row_idx" not in df.columns:
        df = row_numbers(df)
    return df.select(F.col("row_idx").cast("bigint"), F.col("src").cast("string"), F.col("tgt").cast("string"))


def write_table(df: DataFrame, path: str, order: list[str]) -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "xlsx":
        write_xlsx(df, path, order)
    elif kind == "csv":
        df.write.mode("overwrite").option("escape", '"').csv(path, header=True)
    else:
        df.write.mode("overwrite").format({"jsonl": "json"}.get(kind, kind)).save(path)
