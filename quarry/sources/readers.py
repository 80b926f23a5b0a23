"""Sources: tolerant JSON lines, documents as files, vectors, overlays."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what may be uploaded, and how much of a document is read
SUFFIXES = (".pdf", ".docx", ".xlsx", ".txt", ".md", ".csv", ".log")
MAX_BYTES, MAX_TEXT, MAX_PAGE, MAX_PAGES, MAX_SHEETS, MAX_ROWS = 50 << 20, 200_000, 50_000, 200, 50, 500


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, keep_bad: bool = False) -> DataFrame:
    """Rows of JSON lines; lines that aren't JSON are left out, or kept in _corrupt for counting."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("row")).select("row.*")
    return rows if keep_bad else rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def valid_chunks(rows: DataFrame) -> DataFrame:
    """Chunks with an id (chunk_id, else id) and a text that isn't blank."""
    ids = [F.col(c) for c in ("chunk_id", "id") if c in rows.columns]
    return rows.withColumn("chunk_id", F.coalesce(*ids)).where(F.col("chunk_id").isNotNull() & (F.trim("text") != ""))


def result_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-file JSON results of a folder."""
    return spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.full.json").json(folder)


def vectors(rows: DataFrame, size: int, vector: str = "vector") -> DataFrame:
    """Vectors of the expected size; others are left out."""
    return rows.where(F.size(vector) == size)


def overlay_chunks(spark: SparkSession, folder: str, chunk: T.StructType) -> DataFrame:
    """Chunks of an overlay folder of JSON files (each an object with document_id and chunks), of the newest file of each
    document: chunk_id, document_id, text and the other fields of `chunk`.

    Files that can't be read and chunks without an id or text are left out; of equally new files the last by name counts.
    """
    kind = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("chunks", T.ArrayType(chunk))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    read = files.select(F.struct("modificationTime", "path").alias("at"), F.from_json(F.col("content").cast("string"), kind).alias("file")).select("at", "file.*").where("document_id IS NOT NULL")
    newest = read.groupBy("document_id").agg(F.max_by("chunks", "at").alias("chunks"))
    return valid_chunks(newest.select("document_id", F.inline("chunks")))


def with_overlay(base: DataFrame, overlay: DataFrame, key: str = "document_id") -> DataFrame:
    """A base table without the documents that an overlay has, and the overlay; columns that one lacks are null there."""
    newer = valid_chunks(overlay)
    return base.join(newer.select(key).distinct(), key, "left_anti").select(base.columns).unionByName(newer, allowMissingColumns=True)


def admitted(files: DataFrame) -> DataFrame:
    """Files (path, length, content) of allowed kinds and sizes, with a document id."""
    suffix = F.regexp_extract(F.lower("path"), r"(\.[a-z0-9]+)$", 1)
    return files.where(suffix.isin(*SUFFIXES) & (F.col("length") <= MAX_BYTES)).withColumn("suffix", suffix).withColumn("document_id", F.concat(F.lit("doc_"), F.substring(F.sha1("path"), 1, 12)))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_text(content: bytes) -> list[str]:
    return [content.decode("utf-8", "replace")[:MAX_TEXT]]


def read_docx(content: bytes) -> list[str]:
    """One page: the paragraphs that aren't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as whole:
        tree = ElementTree.fromstring(whole.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in tree.iter(f"{_W}p"))
    return ["\n".join(p for p in paragraphs if p.strip())[:MAX_TEXT]]


def read_xlsx(content: bytes) -> list[str]:
    """One page a sheet: its name, and its rows with tabs between cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as whole:
        names = whole.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in ElementTree.fromstring(whole.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(whole.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
        pages = []
        for title, name in list(zip(titles, sheets, strict=False))[:MAX_SHEETS]:
            lines = []
            for row in list(ElementTree.fromstring(whole.read(name)).iter(f"{_S}row"))[:MAX_ROWS]:
                cells = []
                for cell in row.iter(f"{_S}c"):
                    value = cell.find(f"{_S}v")
                    raw = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if value is None else value.text or ""
                    cells.append(shared[int(raw)] if cell.get("t") == "s" and raw else raw)
                if any(c.strip() for c in cells):
                    lines.append("\t".join(cells))
            pages.append("\n".join([f"Sheet: {title}", *lines])[:MAX_PAGE])
    return pages


READERS: dict[str, Callable[[bytes], list[str]]] = {".docx": read_docx, ".xlsx": read_xlsx, **dict.fromkeys((".txt", ".md", ".csv", ".log"), read_text)}


def pages(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """Pages of admitted files: document_id, path, page, text, status.

    A file that can't be read is one page that says so; a file without text is one page with a warning.  A PDF
    reader may be given under ".pdf".
    """
    known = READERS | (readers or {})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file in batch.itertuples(index=False):
                try:
                    found = [(k, text[:MAX_TEXT], "ok") for k, text in enumerate(known[file.suffix](file.content)[:MAX_PAGES], 1) if text.strip()]
                    found = found or [(1, "[no text was found]", "warning")]
                except Exception as error:  # noqa: BLE001  a broken file is a row, not a failed job
                    found = [(1, f"[this file can't be read: {type(error).__name__}]", "error")]
                rows += [(file.document_id, file.path, *page) for page in found]
            yield pd.DataFrame(rows, columns=["document_id", "path", "page", "text", "status"])

    return files.select("document_id", "path", "suffix", "content").mapInPandas(read, "document_id string, path string, page int, text string, status string")


def file_pages(spark: SparkSession, folder: str, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    return pages(admitted(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)), readers)


def known_year(year: str = "year") -> Column:
    """A year as a number from 1900 to 2100, else null."""
    number = F.col(year).try_cast("int")
    return F.when(number.between(1900, 2100), number)
