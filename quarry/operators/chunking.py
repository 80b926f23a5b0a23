"""Documents into chunks: texts mended, parts packed to a size, long ones cut at sentence ends, tails repeated.

Parts (pages, slides, rows, paragraphs, tables) are ordinary rows, sorted by document and streamed through tasks, so a
long document doesn't have to fit a group.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: characters of a chunk, of the tail that the next one repeats, and of the shortest chunk of a batch
TARGET, OVERLAP, LEAST = 2500, 300, 120
# fixed values: signs that a long paragraph is cut after, the best first
CUT_AFTER = (". ", "; ", ": ", " ")
# fixed values: most letters of a heading, the share of capitals beyond which it is one; least characters of a buffer that
# a sentence end closes, and of the line that opens the next
HEADING, CAPITALS, CLOSED, OPENED = 80, 0.65, 80, 20

_SIGNS = str.maketrans({"\0": " ", "\r": "\n", "−": "-", "–": "-", "—": "-", "\uf0b7": "•"})
#: What a line is by its form: a page's number, nothing, an item of a list, or other text.
_FORM = re.compile(r"(?P<number>\|?\s*\d{1,4}\s*)|(?P<blank>)|(?P<item>(?:\d+[.)]|[•-])\s.*)|(?P<text>.+)")
#: Signs after which a sentence may be over.
_OVER = ".!?;:"


def _form(line: str) -> str:
    """number, blank, item, heading or text."""
    form = _FORM.fullmatch(line).lastgroup
    letters = [c for c in line if c.isalpha()] if form == "text" and len(line) <= HEADING else []
    return "heading" if letters and sum(map(str.isupper, letters)) > CAPITALS * len(letters) else form


def _blocks(lines: Iterable[str]) -> Iterator[list[str]]:
    """Runs of lines that no blank line, heading or list item parts; a word that a hyphen breaks holds lines together."""
    block: list[str] = []
    for form, line in ((_form(line), line) for line in lines):
        broken_word = bool(block) and block[-1].endswith("-") and line[:1].islower()
        if form == "blank" or (form in ("heading", "item") and not broken_word):
            yield block
            block = []
        if form not in ("blank", "number"):
            block.append(line)
    yield block


def _paragraphs(block: Sequence[str]) -> Iterator[str]:
    """A block as one text, parted at those ends of sentences that stand far enough from the part before."""
    whole, ends = "", []
    for line in block:
        joint = "" if not whole or (whole.endswith("-") and line[0].islower()) else " "
        if joint and whole[-1] in _OVER and len(line) > OPENED:
            ends.append(len(whole))
        whole += joint + line
    begin = 0
    for end in ends:
        if end - begin > CLOSED:
            yield whole[begin:end]
            begin = end + 1
    if whole:
        yield whole[begin:]


def mended(text: str | None) -> str:
    """A text as paragraphs, one a line: broken lines joined, page numbers left out, dashes and spaces made alike.

    Headings, list items, blank lines and ended sentences of long paragraphs begin a new one; a hyphen at a line's end
    joins a word.
    """
    lines = (" ".join(line.split()) for line in (text or "").replace("\r\n", "\n").translate(_SIGNS).split("\n"))
    return "\n".join(p for block in _blocks(lines) for p in _paragraphs(block))


def _cut(paragraph: str, target: int, overlap: int) -> list[str]:
    """Pieces of a long paragraph, each ended after the last sentence, clause or word of its second half; each begins
    `overlap` characters before the last one's end."""
    # all places to cut after, by sign; the cuts are then looked up among them
    places = [[m.end() for m in re.finditer(re.escape(sign), paragraph)] for sign in CUT_AFTER]

    def last(start: int) -> int:
        full = start + target
        for sign, ends in zip(CUT_AFTER, places, strict=True):
            at = bisect_right(ends, full) - 1
            if at >= 0 and ends[at] - len(sign) > start + target / 2:
                return ends[at]
        return full

    spans = [(0, len(paragraph) if target >= len(paragraph) else last(0))]
    while spans[-1][1] < len(paragraph):
        start = max(spans[-1][1] - overlap, spans[-1][0] + 1)
        spans.append((start, len(paragraph) if start + target >= len(paragraph) else last(start)))
    return [piece for begin, end in spans if (piece := paragraph[begin:end].strip())]


def pieces(text: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """A text as chunks: paragraphs packed to `target` characters, long ones cut, each chunk after the tail of the last.

    With tails, chunks may be longer than the target.
    """
    whole = mended(text)
    if len(whole) <= target:
        return [whole] if whole else []
    out: list[str] = []
    open_chunk = False
    for paragraph in whole.split("\n"):
        if open_chunk and len(out[-1]) + 1 + len(paragraph) <= target:
            out[-1] += "\n" + paragraph
        elif len(paragraph) <= target:
            out.append(paragraph)
            open_chunk = True
        else:
            out.extend(_cut(paragraph, target, overlap))
            open_chunk = False
    if overlap <= 0:
        return out
    tails = ["", *(chunk[-overlap:].strip() for chunk in out)]
    return [f"{tail}\n{chunk}" if tail else chunk for tail, chunk in zip(tails, out, strict=False)]


#: Joins the paragraphs of one part, which are mended each on its own.
PARAGRAPH_MARK = "\x1e"

_CHUNK = "chunk int, section string, place int, first int, last int, text string"


def chunk_parts(parts: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks of parts: document, chunk (from 0), section, place, first, last, text.

    parts: document, section (a name), place (of the section in the document), number (of the part in the section; null
    for a part that is cut alone), text.  Parts of one section and place are packed while they fit the target.
    Null and blank parts, parts without a document, and chunks shorter than `least` are left out.
    """
    kind = parts.schema["document"].dataType.simpleString()
    rows = parts.select("document", "section", F.col("place").cast("int").alias("place"), F.col("number").cast("int").alias("number"), F.col("text").cast("string").alias("text")).where("document IS NOT NULL AND trim(text) <> ''")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[tuple] = []
        group, held, index = None, [], 0  # the open section, its parts that fit so far, the document's next chunk

        def close() -> None:
            nonlocal index
            if held:
                document, section, place = group
                for text in pieces("\n".join(t for _, t in held), target, overlap):
                    if len(text) >= least:
                        made.append((document, index, section, place, held[0][0], held[-1][0], text))
                        index += 1
            held.clear()

        for batch in batches:
            for document, section, place, number, text in batch.itertuples(index=False):
                number = None if pd.isna(number) else int(number)
                key = (document, section, place)
                text = "\n".join(filter(None, map(mended, text.split(PARAGRAPH_MARK))))
                if key != group or number is None or sum(len(t) + 1 for _, t in held) + len(text) > target:
                    close()
                if group is None or document != group[0]:
                    index = 0
                group = key
                if text:
                    held.append((number, text))
            frame = pd.DataFrame(made, columns=["document", *(c.split()[0] for c in _CHUNK.split(", "))])
            made.clear()
            yield frame.astype({"first": "Int32", "last": "Int32"})
        close()
        yield pd.DataFrame(made, columns=["document", *(c.split()[0] for c in _CHUNK.split(", "))]).astype({"first": "Int32", "last": "Int32"})

    ordered = rows.repartition("document").sortWithinPartitions("document", "place", "section", "number", "text")
    return ordered.mapInPandas(pack, f"document {kind}, {_CHUNK}")


def chunk_pages(pages: DataFrame, document: str, number: str, text: str, target: int = TARGET, overlap: int = 0, least: int = 1) -> DataFrame:
    """Chunks of documents given as numbered parts (pages, slides, turns): document, chunk, first, last, text."""
    parts = pages.select(F.col(document).alias("document"), F.lit("page_text").alias("section"), F.lit(0).alias("place"), F.col(number).alias("number"), F.col(text).alias("text"))
    return chunk_parts(parts, target, overlap, least).drop("section", "place")


def chunk_rows(rows: DataFrame, document: str, sheet: str, number: str, cells: list[str], target: int = TARGET, overlap: int = 0, least: int = 1) -> DataFrame:
    """Chunks of spreadsheet rows, sheet by sheet (in order of names): document, chunk, sheet, first, last, text."""
    place = F.dense_rank().over(Window.partitionBy(document).orderBy(sheet))
    text = _row_text(F.col(number), F.array(*(F.col(c).cast("string") for c in cells)))
    parts = rows.select(F.col(document).alias("document"), F.col(sheet).cast("string").alias("section"), place.alias("place"), F.col(number).alias("number"), text.alias("text"))
    return chunk_parts(parts, target, overlap, least).withColumnRenamed("section", "sheet").drop("place")


def _row_text(number, cells):  # noqa: ANN001, ANN202
    """A table row as text, nothing where all cells are empty."""
    shown = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    return F.when(F.size(shown) > 0, F.concat(F.lit("row_"), number, F.lit(": "), F.array_join(shown, " | ")))


def document_parts(documents: DataFrame) -> DataFrame:
    """Parsed documents as parts for `chunk_parts`, by content_type (pages, document, slides, spreadsheet; others have none).

    documents: document_id, content_type, pages and slides (arrays of number and text), paragraphs (array of strings),
    tables (array of table_index and rows), sheets (array of sheet_name and rows); rows are arrays of cells.
    """
    of = lambda kind: documents.where(F.col("content_type") == kind)

    def part(section, place, number, text):  # noqa: ANN001, ANN202
        return ["document_id", section.alias("section"), place.cast("int").alias("place"), number.cast("int").alias("number"), text.alias("text")]

    none, one = F.lit(None), F.lit(0)
    row_texts = lambda rows: F.transform(rows, lambda cells, k: _row_text(k + 1, cells))
    pages = of("pages").select("document_id", F.inline("pages")).toDF("document_id", "number", "text").select(*part(F.lit("page_text"), one, F.col("number"), F.col("text")))
    slides = of("slides").select("document_id", F.inline("slides")).toDF("document_id", "number", "text").select(*part(F.lit("slide_text"), one, F.col("number"), F.col("text")))
    plain = of("document").select(*part(F.lit("paragraph_text"), one, none, F.array_join("paragraphs", PARAGRAPH_MARK)))
    tables = of("document").select("document_id", F.inline("tables")).toDF("document_id", "at", "rows").select(*part(F.concat(F.lit("table_"), F.col("at")), F.col("at") + 1, none, F.array_join(row_texts(F.col("rows")), "\n")))
    sheets = of("spreadsheet").select("document_id", F.posexplode("sheets").alias("at", "sheet")).select("document_id", "at", "sheet.*").toDF("document_id", "at", "name", "rows")
    lines = sheets.select("document_id", "at", "name", F.posexplode(row_texts(F.col("rows"))).alias("k", "text")).select(*part(F.col("name"), F.col("at"), F.col("k") + 1, F.col("text")))
    out = pages
    for more in (slides, plain, tables, lines):
        out = out.unionByName(more)
    return out.withColumnRenamed("document_id", "document")


def chunk_documents(documents: DataFrame, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks of parsed documents with ids: chunk_id and the columns of `chunk_parts`."""
    made = chunk_parts(document_parts(documents), target, overlap, least)
    mark = F.concat_ws(":", "document", "chunk", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12))
    return made.withColumn("chunk_id", F.concat(F.lit("chunk_"), F.substring(F.sha1(mark.cast("binary")), 1, 16)))


def chunk_online(pages: DataFrame, document: str, number: str, text: str, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of an uploaded document's pages, each page by itself and short ones too: chunk_id, document, chunk, page, text."""
    parts = pages.select(F.col(document).alias("document"), F.lit("page_text").alias("section"), F.col(number).alias("place"), F.lit(None).cast("int").alias("number"), F.col(text).alias("text"))
    made = chunk_parts(parts, target, overlap, 1)
    mark = F.concat_ws(":", "document", "chunk", F.substring("text", 1, 200))
    chunk_id = F.concat(F.lit("chunk_"), F.substring(F.sha1(mark.cast("binary")), 1, 18))
    return made.select(chunk_id.alias("chunk_id"), "document", "chunk", F.col("place").alias("page"), "text")


def counters(chunks: DataFrame, *columns: str) -> DataFrame:
    """Chunks of each combination of attributes (unknown where missing): the attributes, cnt."""
    return chunks.groupBy(*(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns)).agg(F.count("*").alias("cnt"))


def with_tails(chunks: DataFrame, document: str, order: str, size: int = OVERLAP) -> DataFrame:
    """Prepends the last characters of the chunk before to each chunk's text."""
    before = F.lag("text").over(Window.partitionBy(document).orderBy(order))
    return chunks.withColumn("text", F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.right(before, F.lit(size)), F.lit("\n"), F.col("text"))))
