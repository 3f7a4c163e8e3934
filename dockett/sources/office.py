"""Cells of spreadsheets and word-processor files as a table, by a data source of its own.

A zipped file of XML is one task's work, so files are planned into tasks of about as many bytes; a task reads each
file's parts as a stream and gives its cells on in batches, so its memory is bounded by a row of a sheet and the list of
shared strings, not by a file. A file that cannot be opened or ends in the middle gives one row with its error.

    spark.dataSource.register(office.Cells)
    spark.read.format("office_cells").option("paths", json.dumps([...])).load()
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import readers

#: Bytes of files that a task takes, about; cells handed over at once; shared strings that a workbook may have (more are an
#: error of the file), and columns of a row.
TASK_BYTES, BATCH, STRINGS, COLUMNS = 32 << 20, 4096, 2_000_000, 16_384
SCHEMA = "path string, tbl int, row int, col int, text string, sheet string, error string"
_ARROW = pa.schema([("path", pa.string()), ("tbl", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("sheet", pa.string()), ("error", pa.string())])
#: Paragraphs outside tables stand in table 0, a row each.
PARAGRAPHS = 0
Cell = tuple[int, int, int, str, str]


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _streamed(f: IO[bytes]) -> Iterator[tuple[str, ElementTree.Element]]:
    """Starts and ends of elements; what has ended is let go by the caller's clear()."""
    yield from ElementTree.iterparse(f, events=("start", "end"))


def _strings(book: zipfile.ZipFile) -> list[str]:
    found: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            root = None
            for event, e in _streamed(f):
                root = e if root is None else root
                if event == "end" and _name(e.tag) == "si":
                    # Phonetic readings stand beside the text, not in it.
                    found.append("".join(t.text or "" for part in e if _name(part.tag) in ("t", "r") for t in part.iter() if _name(t.tag) == "t"))
                    if len(found) > STRINGS:
                        raise ValueError(f"more than {STRINGS} shared strings")
                    root.clear()
    return found


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, part) of the sheets in the workbook's order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        parts = {e.get("Id"): e.get("Target", "") for e in ElementTree.parse(f).getroot()}
    with book.open("xl/workbook.xml") as f:
        listed = [(e.get("name", ""), next((v for k, v in e.attrib.items() if _name(k) == "id"), "")) for e in ElementTree.parse(f).getroot().iter() if _name(e.tag) == "sheet"]
    return [(title, parts[i].lstrip("/") if parts[i].startswith("/") else f"xl/{parts[i]}") for title, i in listed if i in parts]


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def _shown(kind: str, value: str, strings: list[str]) -> str:
    """A cell's text: shared strings by number, truth values and whole numbers as they are written out."""
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "inlineStr", "e", "d") or not value:
        return value
    x = float(value)
    return str(int(value)) if re.fullmatch(r"[-+]?\d+", value) else str(int(x)) if x.is_integer() and "." not in value and abs(x) < 2**53 else repr(x)


def workbook(f: IO[bytes]) -> Iterator[Cell]:
    """(table, row, column, text, sheet) of the cells with a value, each sheet a table; columns from 0."""
    with zipfile.ZipFile(f) as book:
        strings = _strings(book)
        for n, (title, part) in enumerate(_sheets(book), 1):
            with book.open(part) as sheet:
                row, col, root = 0, 0, None
                for event, e in _streamed(sheet):
                    name = _name(e.tag)
                    if event == "start" and name == "sheetData":
                        root = e
                    elif event == "start" and name == "row":
                        row, col = int(e.get("r") or row + 1), 0
                    elif event == "end" and name == "c":
                        col = _column(e.get("r", "")) or col + 1
                        if col > COLUMNS:
                            raise ValueError(f"more than {COLUMNS} columns")
                        kind = e.get("t", "n")
                        wanted = "t" if kind == "inlineStr" else "v"
                        text = _shown(kind, "".join(x.text or "" for x in e.iter() if _name(x.tag) == wanted), strings).strip()
                        if text:
                            yield n, row, col - 1, text, title
                        e.clear()
                    elif event == "end" and name == "row" and root is not None:
                        root.clear()


def document(f: IO[bytes]) -> Iterator[Cell]:
    """(table, row, column, text, "") of a word-processor file: its paragraphs as table PARAGRAPHS, a row each, and its tables
    from 1; a cell that spans columns stands in each of them."""
    with zipfile.ZipFile(f) as book, book.open("word/document.xml") as body:
        tables, row, col, depth, paragraphs = 0, 0, 0, 0, 0
        texts: list[str] = []
        words: list[str] = []
        span, root = 1, None
        for event, e in _streamed(body):
            name = _name(e.tag)
            if event == "start":
                if name == "body":
                    root = e
                elif name == "tbl":
                    depth += 1
                    if depth == 1:
                        tables, row = tables + 1, 0
                elif depth == 1 and name == "tr":
                    row, col = row + 1, 0
                elif depth == 1 and name == "tc":
                    texts, span = [], 1
                continue
            if name == "gridSpan" and depth == 1:
                span = min(int(next((v for k, v in e.attrib.items() if _name(k) == "val"), "1")), COLUMNS)
            elif name == "t":
                words.append(e.text or "")
            elif name in ("tab", "br", "cr"):
                words.append("\t" if name == "tab" else "\n")
            elif name == "p":
                text, words = "".join(words), []
                if depth:
                    texts.append(text)
                else:
                    paragraphs += 1
                    if text.strip():
                        yield PARAGRAPHS, paragraphs, 0, text.strip(), ""
            elif name == "tc" and depth == 1:
                for _ in range(span):
                    yield tables, row, col, "\n".join(texts).strip(), ""
                    col += 1
            elif name == "tbl":
                depth -= 1
            if not depth and root is not None and name in ("p", "tbl"):
                root.clear()
            elif name == "tr" and depth == 1:
                e.clear()


KINDS = {".xlsx": workbook, ".xlsm": workbook, ".docx": document}


def cells_of(path: str, f: IO[bytes]) -> Iterator[tuple]:
    """Rows of SCHEMA of one file; what it gave before an error stays, and the error follows."""
    try:
        read = KINDS[path[path.rfind(".") :].lower()]
        for tbl, row, col, text, sheet in read(f):
            yield path, tbl, row, col, text, sheet, None
    except Exception as e:  # noqa: BLE001  whatever a file does, the others are read
        yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def planned(sized: list[tuple[str, int]]) -> list[list[str]]:
    """Files by falling size into tasks of about TASK_BYTES, a larger file alone."""
    tasks: list[list[str]] = []
    left = 0
    for path, size in sorted(sized, key=lambda x: (-x[1], x[0])):
        if not tasks or left < size:
            tasks.append([])
            left = TASK_BYTES
        tasks[-1].append(path)
        left -= size
    return tasks


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.sized = [(p, int(n)) for p, n in json.loads(options["files"])]

    def partitions(self) -> list[InputPartition]:
        return [Files(paths) for paths in planned(self.sized)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows: list[tuple] = []
        for path in partition.paths:
            store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)
            try:
                opened = store.open_input_file(at)
            except OSError as e:
                rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
                continue
            with opened as f:
                for row in cells_of(path, f):
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class Cells(DataSource):
    """Option files: a list of (path, bytes) as JSON."""

    @classmethod
    def name(cls) -> str:
        return "office_cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def cells(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """SCHEMA of the cells of files, given with their sizes, by which they are dealt over tasks."""
    spark.dataSource.register(Cells)
    return spark.read.format("office_cells").option("files", json.dumps(files)).load()


def texts(cells: DataFrame) -> DataFrame:
    """path, text, error: one row a file that has cells or an error.

    A sheet's row is a line of its cells, set apart by tabs; paragraphs are lines, and so are rows of a document's
    tables, with bars between cells and merged ones taken once. A table that lists containers adds a line with their
    number. What stands before an error is not taken.
    """
    whole = cells.filter("error is null").withColumn("sheets", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)) != ".docx")
    at = F.array_sort(F.collect_list(F.struct("col", "text")))
    rows = whole.groupBy("path", "tbl", "row", "sheets").agg(at.alias("c"), F.max("col").alias("last"))
    by = F.map_from_entries("c")
    spread = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at(by, i), F.lit("")))
    rows = rows.withColumn("x", spread)
    once = F.filter("x", lambda x, i: (i == 0) | (x != F.get(F.col("x"), i - 1)))
    line = F.when(F.col("sheets"), F.array_join("x", "\t")).otherwise(F.array_join(once, " | "))
    lines = rows.filter(F.exists("x", lambda x: x != "")).select("path", "tbl", "row", line.alias("line"))
    tables = whole.filter(~F.col("sheets") & (F.col("tbl") > PARAGRAPHS)).withColumnRenamed("path", "doc")
    counts = readers.table_chunks(tables).filter("row is null").select(F.col("doc").alias("path"), "tbl", F.lit(2**31 - 1).alias("row"), F.concat("label", F.lit(": "), "value").alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("tbl", "row", "line")))
    folded = lines.unionByName(counts).groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    failed = cells.filter("error is not null").groupBy("path").agg(F.min("error").alias("error"))
    return folded.join(failed, "path", "full_outer").select("path", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
