"""Documents of any supported format as one table of parsed rows.

``read_files`` scans a folder, ``parse`` turns (doc_id, filename, content) into one row per
document. A document that cannot be read gives a row with an error class and a message;
it never fails the job. Files over the limit are refused by their length, which the scan
knows without reading them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docsift.operators import layout
from docsift.sources import inputs
from docsift.sources.docx import DocxError, Reader
from docsift.sources.pdf import UNMAPPED, Document, PdfError
from docsift.sources.rtf import RtfError, rtf_text

SPAN = "page_no int, seq int, x double, y double, size double, font string, text string, hidden boolean"
PAGE = "page_no int, width double, height double, images int, mailto array<string>"
PARA = "p_no int, text string, size_pt double, bold boolean, italic boolean, color string, font string, is_bullet boolean, ilvl int, glyph_bullet boolean, has_bottom_rule boolean, is_hyperlink boolean"
SECTION = "page_w int, page_h int, mt double, mb double, ml double, mr double, n_cols int, header_text string, footer_text string, author string, title string"


def _struct(fields: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>"


SCHEMA = (
    f"doc_id long, filename string, kind string, status string, error_class string, message string, text string, stream_text string, band_text string, multi_column_pages array<int>, spans array<{_struct(SPAN)}>, pages array<{_struct(PAGE)}>,"
    f" paras array<{_struct(PARA)}>, section {_struct(SECTION)}, tables int, textboxes int, images int, n_unmapped int, hidden_text string, truncated string"
)
#: Rows and bytes of files after which a batch of parsed documents is handed on.
BATCH_ROWS, BATCH_BYTES = 128, 1 << 20
ADVICE = {".pages": "Export to PDF or DOCX first.", ".doc": "Save as DOCX first.", ".odt": "Export to PDF or DOCX first.", ".html": "Save as PDF first.", ".htm": "Save as PDF first."}


class UnsupportedFormat(ValueError):
    """No reader for this kind of file."""


class InputTooLarge(ValueError):
    """A file over the limit, which is not read."""


def _suffix(name: str) -> str:
    base = (name or "").rpartition("/")[2]
    return ("." + base.rpartition(".")[2].lower()) if "." in base[1:] else ""


def parse_one(name: str, data: bytes, spans_too: bool = True) -> dict:
    """Parsed parts of one document; raises an error class that names the trouble."""
    suffix = _suffix(name)
    if not data:
        raise UnsupportedFormat("the file is empty")
    if suffix in ADVICE and not (suffix == ".doc" and data[:4] == b"PK\x03\x04"):
        raise UnsupportedFormat(f"{suffix} files are not read. {ADVICE[suffix]}")
    if suffix == ".pdf" or data[:4] == b"%PDF":
        document = Document(data)
        pages = document.pages()
        spans, laid = [s for p in pages for s in p.spans], layout.placed(pages)
        return {
            "kind": "pdf",
            **laid,
            "spans": [{"page_no": s.page_no, "seq": s.seq, "x": s.x, "y": s.y, "size": s.size, "font": s.font, "text": s.text, "hidden": s.hidden} for s in spans] if spans_too else [],
            "pages": [{"page_no": p.number, "width": p.width, "height": p.height, "images": p.images, "mailto": p.mailto} for p in pages],
            "images": sum(p.images for p in pages),
            "n_unmapped": laid["stream_text"].count(UNMAPPED),
            "hidden_text": " ".join(s.text for s in spans if s.hidden),
            "truncated": "; ".join(sorted(document.cut)) or None,
        }
    if suffix in (".docx", ".doc") or data[:4] == b"PK\x03\x04":
        try:
            m = Reader(data).model()
        except DocxError as wrong:
            raise UnsupportedFormat(f"not a DOCX: {wrong}") from wrong
        names = [f.split(" ")[0] for f in SECTION.split(", ")]
        return {
            "kind": "docx",
            "text": "\n".join(p.text for p in m.paras),
            "paras": [vars(p) for p in m.paras],
            "section": {n: getattr(m, n) for n in names},
            "tables": m.tables,
            "textboxes": m.textboxes,
            "images": m.images,
            "hidden_text": m.hidden_text,
        }
    if suffix == ".rtf" or data.startswith(b"{\\rtf"):
        return {"kind": "rtf", "text": rtf_text(data)}
    if suffix in (".txt", ".md", ".markdown", ""):
        return {"kind": "markdown" if suffix in (".md", ".markdown") else "text", "text": data.decode("utf-8-sig", "replace").replace("\r\n", "\n")}
    raise UnsupportedFormat(f"{suffix} files are not read")


def in_batches(each: Iterator[tuple[dict, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (row, bytes); keys of a row that the schema lacks are left out."""
    rows, size = [], 0
    for row, n in each:
        rows.append(row)
        size += n
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, a few at a time in memory as Python's objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, BATCH_ROWS).columns), strict=True)


def _rows(schema: pa.Schema, also=None, keep: Iterable[str] = ()):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for doc_id, name, data, length, *kept in each_row(batches):
            row = dict(zip(keep, kept, strict=True)) | {"doc_id": doc_id, "filename": (name or "").rpartition("/")[2], "status": "ok", "tables": 0, "textboxes": 0, "images": 0, "n_unmapped": 0}
            try:
                if data is None and length:
                    raise InputTooLarge(f"the file has {length} bytes, which are more than are read")
                row |= parse_one(name or "", data or b"", "spans" in schema.names)
                if also:
                    row |= also(row)
            except (InputTooLarge, UnsupportedFormat, PdfError, RtfError) as wrong:
                row |= {"status": "error", "error_class": type(wrong).__name__, "message": str(wrong)}
            except Exception as wrong:  # a reader's defect must not fail the other documents
                row |= {"status": "error", "error_class": type(wrong).__name__, "message": "the document could not be processed"}
            yield row, len(data or b"")

    return lambda batches: in_batches(each(batches), schema)


def parse(files: DataFrame, only: Iterable[str] | None = None, also=None, more: str = "", keep: Iterable[str] = ()) -> DataFrame:
    """One row of ``SCHEMA`` for each row (doc_id, filename, content).

    Null content is an error row: the file is over the limit if a column ``length`` says so,
    else there is nothing to read.
    ``only`` names the columns that are wanted, so that no others are made. ``also`` works out
    further columns of the DDL ``more`` from what was parsed, while it is at hand. ``keep`` names columns of
    ``files`` that go with the document as they are.
    """
    fields = [f for f in StructType.fromDDL(SCHEMA).fields if only is None or f.name in set(only)]
    schema = StructType(fields + (StructType.fromDDL(more).fields if more else []) + [files.schema[c] for c in keep])
    length = F.col("length").cast("long") if "length" in files.columns else F.lit(None).cast("long")
    return files.select("doc_id", "filename", "content", length.alias("length"), *keep).mapInArrow(_rows(to_arrow_schema(schema), also, keep), schema)


def read_files(spark: SparkSession, path: str, most_bytes: int = inputs.MAX_FILE_BYTES) -> DataFrame:
    """(doc_id, path, filename, folder, length, content) of all files below a folder.

    Larger ones have null content, which no scan has read; :func:`parse` makes error rows of them.
    Pick columns before using them: content is read only if it is asked for.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name, folder = F.regexp_extract("path", "([^/]*)$", 1), F.regexp_extract("path", "([^/]*)/[^/]*$", 1)
    named = [F.xxhash64("path").alias("doc_id"), "path", name.alias("filename"), folder.alias("folder"), "length"]
    large = files.drop("content").filter(F.col("length") > most_bytes).select(*named, F.lit(None).cast("binary").alias("content"))
    return files.filter(F.col("length") <= most_bytes).select(*named, "content").unionByName(large)


def oversize_files(spark: SparkSession, path: str, most_bytes: int = inputs.MAX_FILE_BYTES) -> DataFrame:
    """Error rows of files that are refused by length alone; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    message = F.concat(F.lit("the file has "), F.col("length").cast("string"), F.lit(f" bytes, {most_bytes} at most are read"))
    rows = files.select("path", "length").filter(F.col("length") > most_bytes)
    return rows.select(F.xxhash64("path").alias("doc_id"), F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), F.lit("error").alias("status"), F.lit("InputTooLarge").alias("error_class"), message.alias("message"))


def spans_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("spans"))


def paras_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("paras"))
