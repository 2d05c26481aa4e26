"""The three jobs that users run, over any number of documents at once.

Inputs are DataFrames (doc_id, filename, content), see ``docsift.sources.documents``; job
descriptions are (jd_id, text). Each function returns DataFrames; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import report
from docsift.operators import gate, layout, lint, matching, parity
from docsift.scratch import written
from docsift.session import bounded_batches, ship
from docsift.sources import documents

#: What layout, findings and extracted text need of a parsed document.
LAID_OUT = (
    "doc_id", "filename", "kind", "status", "error_class", "message", "text", "stream_text", "band_text", "multi_column_pages", "pages", "section", "tables", "textboxes", "images", "n_unmapped",
    "hidden_text", "truncated",
)


def parsed(files: DataFrame, only: Iterable[str] | None = None) -> DataFrame:
    """Parsed and laid-out documents as the result is read; ``only`` names the columns that the reader makes."""
    ship(files.sparkSession)
    bounded_batches(files.sparkSession)
    return layout.extracted(documents.parse(files, only))


def load(files: DataFrame) -> DataFrame:
    """Parsed and laid-out documents, written once as several operators read them."""
    return written(parsed(files), "extracted")


def extract(files: DataFrame, stream_order: bool = False) -> DataFrame:
    """Text of each document, read column by column or in the order of its content stream."""
    return layout.extract_text(load(files).filter("status = 'ok'"), stream_order)


def errors(loaded: DataFrame) -> DataFrame:
    """(doc_id, filename, error_class, message, exit_code) of documents that could not be read."""
    return loaded.filter("status = 'error'").select("doc_id", "filename", "error_class", "message", F.lit(2).alias("exit_code"))


def all_findings(loaded: DataFrame) -> DataFrame:
    return lint.findings(loaded).unionByName(lint.stuffing_findings(loaded))


def _pairs(docs: DataFrame, jds: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """(jd_id, doc_id) of what is to be compared: the given pairs, or each document with the only description."""
    if pairs is not None:
        return pairs.select("jd_id", "doc_id").join(docs.select("doc_id"), "doc_id", "left_semi").distinct()
    if len(jds.select("jd_id").take(2)) > 1:
        raise ValueError("with more than one job description, say which documents to compare with which: pairs (jd_id, doc_id)")
    return docs.select("doc_id").crossJoin(F.broadcast(jds.select("jd_id")))  # one row at most: not a product of tables


def jd_struct(loaded: DataFrame, jds: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(jd_id, doc_id, jd): coverage, matched and missing terms and gates of each pair.

    One job description is compared with every document. Any number of them goes with
    ``pairs`` (jd_id, doc_id), each of which gets a row of its own.
    """
    docs = loaded.select("doc_id", "text")
    pairs = written(_pairs(docs, jds, pairs), "pairs")
    conditions = matching.gates(pairs, docs, jds).groupBy("jd_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("kind", "value", "satisfied"))).alias("gates"))
    rows = matching.judged(pairs, docs, jds).join(conditions, ["jd_id", "doc_id"], "left")
    return rows.select("jd_id", "doc_id", F.struct("coverage_required", "matched", "missing", "gates").alias("jd"))


def review(files: DataFrame, jds: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, json, markdown): parseability of each document and, with a job description, its overlap.

    With ``pairs`` (jd_id, doc_id) there is a row for each of them, and for each document
    in none, with a column ``jd_id``.
    """
    loaded = load(files).filter("status = 'ok'")
    found = written(all_findings(loaded), "findings")
    jd = None if jds is None else jd_struct(loaded, jds, pairs)
    if pairs is None and jd is not None:
        jd = jd.drop("jd_id")
    return report.review_report(loaded, found, lint.score(loaded, found), jd)


def validate(files: DataFrame, pdfs: DataFrame | None = None, jds: DataFrame | None = None, spec: dict | None = None, specs: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, title, ok, detail, severity): every check of each file; ``pdfs`` has the same doc_id.

    A file that cannot be read fails ``x_docx.readable`` or ``x_pdf.readable``, and what
    depends on it is null, as are checks that need a PDF or a job description without one.
    ``spec`` replaces values of the specification for all; ``specs`` (owner, version, spec
    VARIANT) does so for the files whose column ``owner`` has that owner.

    Files are read and checked as the result is: a caller that uses it more than once may
    want it ``written`` first.
    """
    return gate.checked(*_judged(files, pdfs, jds, spec, specs))


def verdicts(files: DataFrame, pdfs: DataFrame | None = None, jds: DataFrame | None = None, spec: dict | None = None, specs: DataFrame | None = None) -> DataFrame:
    """:func:`gate.verdict` of :func:`validate`, for files with a doc_id of their own: counted in the file's row."""
    return gate.verdict_inline(*_judged(files, pdfs, jds, spec, specs))


def _judged(files: DataFrame, pdfs: DataFrame | None, jds: DataFrame | None, spec: dict | None, specs: DataFrame | None) -> tuple[DataFrame, list[tuple[str, str, Column, Column, str]]]:
    """A row for each file with what the checks look at, and the checks."""
    given = gate.spec_of(spec)
    ship(files.sparkSession)
    bounded_batches(files.sparkSession)
    docs = gate.read(files, [] if specs is None else ["owner"])
    if jds is not None:
        docs = written(docs, "docs")
    if pdfs is not None:
        rows = parity.with_lacking(docs.join(gate.read_pdf(pdfs), "doc_id", "left"))
    else:
        rows = docs.drop("text").withColumns({n: F.lit(None).cast(t) for n, t in gate.NO_PDF.items()})
    values = gate.spec_columns(given)
    if specs is not None:
        rows, values = gate.with_specs(rows, specs, given)
    cover = conditions = None
    if jds is not None:
        texts = docs.filter("docx_ok").select("doc_id", "text")
        cover, conditions = matching.coverage(texts, jds), matching.gates(_pairs(texts, jds, None), texts, jds)
    checks = [*gate.structure_checks(values), parity.parity_check(), *gate.pdf_checks(values), *gate.jd_checks(values)]
    return gate.with_jd(rows, cover, conditions), checks
