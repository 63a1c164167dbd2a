"""Literature files (TXT, CSV, XLSX, PDF) as chunks. Files are read by executors, each as a whole; bad ones do not stop the rest.

A file is a row of Spark's binary file source, so any store that Spark reads will do. What a file holds becomes units
(the text of a page, or of a table's row), and these become chunks with stable ids, sections and offsets.
"""

from __future__ import annotations

import bisect
import csv
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmass.functions import text
from quillmass.operators import corpus
from quillmass.operators.storage import stored

SUFFIXES = ("pdf", "txt", "csv", "xlsx")
PIECES = "source_file string, file_type string, page int, sheet_name string, row_index int, section string, text string, char_start int, char_end int, number int, status string, error string"
CHUNK_COLUMNS = ("chunk_id", "source_file", "file_type", "page", "sheet_name", "row_index", "section", "text", "char_start", "char_end")


@dataclass
class Unit:
    """A text that is chunked by itself: a page, a whole file or a table's row."""

    text: str
    page: int | None = None
    sheet: str | None = None
    row: int | None = None


# ---- headings


def is_heading(line: str) -> bool:
    """The rule of corpus.is_heading for one line on an executor."""
    s = line.strip()
    if not 0 < len(s) <= 120 or s[-1] in ".;,":
        return False
    if re.match(r"(?:\d+(?:\.\d+)*|[A-Z])[\s.)-]+\S+", s):
        return True
    words = s.split()
    capital = sum(w[0].isupper() for w in words)
    return len(words) <= 12 and any(map(str.isalpha, s)) and (s.isupper() or capital >= max(1, len(words) - 1))


class Sections:
    """The heading that holds at each place of a text. Lines are looked at once."""

    def __init__(self, content: str):
        self.places, self.titles = [], []
        at = 0
        for line in content.splitlines(keepends=True):
            if is_heading(line):
                self.places.append(at)
                self.titles.append(line.strip())
            at += len(line)

    def at(self, place: int) -> str | None:
        i = bisect.bisect_right(self.places, place)
        return self.titles[i - 1] if i else None


# ---- readers


def read_txt(data: bytes) -> list[Unit]:
    return [Unit(data.decode("utf-8-sig", "replace"))]


def shown_row(headers: list[str], values: list[str]) -> str:
    """``header: value`` of the cells that are not empty, joined by bars; a missing header is column_n."""
    named = [*headers, *[""] * max(0, len(values) - len(headers))]
    return " | ".join(f"{named[i] or f'column_{i + 1}'}: {v}" for i, v in enumerate(values) if v)


def rows_as_units(rows: Iterator[list[str]], sheet: str | None) -> Iterator[Unit]:
    """The first row names the cells of the others; row numbers count from 1, as a table's program shows them."""
    headers = [h.strip() for h in next(rows, [])]
    for number, values in enumerate(rows, 2):
        line = shown_row(headers, [v.strip() for v in values])
        if line:
            yield Unit(line, sheet=sheet, row=number)


def read_csv(data: bytes) -> list[Unit]:
    return list(rows_as_units(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"), newline="")), None))


_XL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cell_place(reference: str) -> int:
    """The column (from 0) of a reference like ``AB12``."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell_value(cell, shared: list[str]) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_XL}t"))
    value = cell.find(f"{_XL}v")
    found = "" if value is None else value.text or ""
    if kind == "s":
        return shared[int(found)] if found else ""
    if kind == "b":
        return {"1": "True", "0": "False"}.get(found, "")
    if kind == "n" and found:
        x = float(found)
        return str(int(x)) if x == int(x) and "." not in found and "e" not in found.lower() else str(x)
    return found


def read_xlsx(data: bytes) -> list[Unit]:
    """Every sheet's rows, read from the file's XML parts. Dates are the numbers that the file holds."""
    out: list[Unit] = []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = set(parts.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_XL}t")) for item in ElementTree.fromstring(parts.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(parts.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(parts.read("xl/workbook.xml")).iter(f"{_XL}sheet"):
            target = targets[sheet.get(_REL)]
            target = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows = []
            for row in ElementTree.fromstring(parts.read(target)).iter(f"{_XL}row"):
                number = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(number - len(rows) - 1)]  # rows that the file leaves out
                values: list[str] = []
                for cell in row.iter(f"{_XL}c"):
                    place = _cell_place(cell.get("r") or "") if cell.get("r") else len(values)
                    values += [""] * (place - len(values))
                    values.append(_cell_value(cell, shared))
                rows.append(values)
            out += rows_as_units(iter(rows), sheet.get("name"))
    return out


_PDF_STREAM = re.compile(rb"<<((?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T[jJdDm*]|['\"]|ET")
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].endswith(b"\n") else _PDF_ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def simple_pdf_pages(data: bytes) -> list[str]:
    """The text of content streams, one page each, of files with plain or deflated streams and simple fonts."""
    pages = []
    for head, body in _PDF_STREAM.findall(data):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"BT" not in body:
            continue
        out: list[str] = []
        held: list[str] = []
        for token in _PDF_TEXT.findall(body):
            if token[:1] in b"(<":
                held.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                out.append(("\n" if token in b"'\"" else "") + "".join(held))
                held = []
            else:  # the text moves on
                out.append("\n")
                held = []
        pages.append(re.sub(r"\n+", "\n", "".join(out)).strip("\n"))
    return pages


def read_pdf(data: bytes) -> list[Unit]:
    """Pages by pypdf or PyPDF2 where one is installed, else by the simple reader. Only embedded text is read."""
    reader = None
    for name in ("pypdf", "PyPDF2"):
        try:
            reader = __import__(name).PdfReader
            break
        except ImportError:
            continue
    pages = [p.extract_text() or "" for p in reader(io.BytesIO(data)).pages] if reader else simple_pdf_pages(data)
    return [Unit(p, page=n) for n, p in enumerate(pages, 1)]


READERS = {"txt": read_txt, "csv": read_csv, "xlsx": read_xlsx, "pdf": read_pdf}


# ---- corpus


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """source_file (below the folder), file_type and content of every supported file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # the source writes file:///x where the file system says file:/x
    plain = F.regexp_replace("path", "^([a-z]+):/+", "$1:/")
    name = F.substr(plain, F.lit(len(re.sub("^([a-z]+):/+", r"\1:/", base)) + 2))
    kind = F.lower(F.element_at(F.split(name, r"\."), -1))
    return found.select(name.alias("source_file"), kind.alias("file_type"), "content").filter(F.col("file_type").isin(*SUFFIXES))


def pieces_of(files: DataFrame, size: int, overlap: int) -> DataFrame:
    """The chunks of every file; a file without any gives one row with its status."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, kind, content in zip(batch["source_file"], batch["file_type"], batch["content"], strict=True):
                place = len(rows)
                try:
                    for unit in READERS[kind](bytes(content)):
                        sections = Sections(unit.text) if unit.row is None else None
                        for number, (a, b) in enumerate(corpus.chunk_spans(unit.text, size, overlap)):
                            rows.append((name, kind, unit.page, unit.sheet, unit.row, sections and sections.at(a), unit.text[a:b], a, b, number, "success", ""))
                    if len(rows) == place:
                        rows.append((name, kind, *[None] * 8, "empty", "no extractable text"))
                except Exception as e:  # noqa: BLE001 - one bad document must not end the corpus
                    del rows[place:]
                    rows.append((name, kind, *[None] * 8, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({c: "Int32" for c in ("page", "row_index", "char_start", "char_end", "number")})

    return files.mapInPandas(run, PIECES)


def prepare_corpus(spark: SparkSession, folder: str, size: int = 1200, overlap: int = 200) -> tuple[DataFrame, DataFrame]:
    """Chunks (CHUNK_COLUMNS) of all files below a folder, and a report: file, type, chunks, status, error."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("chunks need a positive size and a smaller overlap")
    pieces = stored(pieces_of(files_below(spark, folder), size, overlap), "corpus")
    chunks = pieces.filter("status = 'success'").withColumn("chunk_id", text.chunk_id(F.col("source_file"), F.col("page"), F.col("sheet_name"), F.col("row_index"), F.col("number")))
    report = pieces.groupBy("source_file", "file_type").agg(F.count("text").alias("chunk_count"), F.first("status").alias("parse_status"), F.first("error").alias("error_message"))
    return chunks.select(*CHUNK_COLUMNS), report


def write_corpus(spark: SparkSession, folder: str, target: str, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Write chunks (JSON lines) and the reports of all and of failed files (CSV) below ``target``; returns the report."""
    chunks, report = prepare_corpus(spark, folder, size, overlap)
    chunks.write.mode("overwrite").json(f"{target}/chunks", ignoreNullFields=False)
    report.write.mode("overwrite").option("header", True).csv(f"{target}/corpus_summary")
    report.filter("parse_status <> 'success'").write.mode("overwrite").option("header", True).csv(f"{target}/parse_failures")
    return report
