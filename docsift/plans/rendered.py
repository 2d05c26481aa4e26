"""Registered queries that send rendered documents through the readers.

The test tables have no PDF or DOCX files, so the words of each document are set as such
files first; the SQL says what the readers, the page layout, the findings and the gate must
make of them. Files differ by ``doc_id``, as the functions' descriptions have it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators import gate, lint
from docsift.plans import api
from docsift.plans.catalogue import _FINDINGS, _FLAGS, query, table
from docsift.session import bounded_batches, ship, spread
from docsift.sources import compose, documents

FILES = "doc_id long, filename string, content binary"
#: What a cell of a page has: so many words of so many characters at most; lines of a page.
CELL, LONGEST, ROWS = 4, 12, 50
#: All that Latin-1 prints; longer runs are set in parts.
_WORD, _WORD_SQL = re.compile(f"[!-~\u00a1-\u00ff]{{1,{LONGEST}}}"), f"[!-~\\x{{A1}}-\\x{{FF}}]{{1,{LONGEST}}}"
BAND = "+44 20 7946 0958"


def _pdf_of(doc_id: int, text: str) -> bytes:
    words = _WORD.findall(text)
    cells = [" ".join(words[i : i + CELL]) for i in range(0, len(words), CELL)]
    across = 1 + (doc_id % 3 == 1)
    pages = []
    for at in range(0, max(len(cells), 1), across * ROWS):
        part = cells[at : at + across * ROWS]
        pages.append([(40 + 290 * (i % across), 730 - 13 * (i // across), 8, cell) for i, cell in enumerate(part)])
    if doc_id % 7 == 0 and cells:
        pages[0].insert(0, (40, 770, 8, BAND))
    return compose.pdf(pages, doc_id % 2 == 0, not cells, "someone@example.org" if doc_id % 5 == 0 else "", 77 * (doc_id % 4 == 3))


def _files(make, suffix: str):
    schema = pa.schema([("doc_id", pa.int64()), ("filename", pa.string()), ("content", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for doc_id, text in documents.each_row(batches):
            content = make(doc_id, text or "")
            yield {"doc_id": doc_id, "filename": f"d{doc_id}.{suffix}", "content": content}, len(content)

    return lambda batches: documents.in_batches(each(batches), schema)


def _rendered(spark, sf_dir: str, make, suffix: str, which: str = "true") -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    texts = table(spark, sf_dir, "documents").filter(which).select("doc_id", "text")
    return spread(texts, "doc_id").mapInArrow(_files(make, suffix), FILES)


_LAID = f"""
  w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}') AS words, CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 1 END AS across FROM documents),
  c AS (SELECT doc_id, across, len(words) AS n, i, array_to_string(words[{CELL} * i + 1 : {CELL} * i + {CELL}], ' ') AS cell
    FROM w, unnest(range((len(words) + {CELL - 1}) // {CELL})) u(i)),
  p AS (SELECT *, i // ({ROWS} * across) AS page, i % ({ROWS} * across) // across AS line, i % across AS side FROM c),
  m AS (SELECT *, count(*) FILTER (side = 1) OVER (PARTITION BY doc_id, page) >= 3 AS multi FROM p),
  b AS (SELECT doc_id, page, line, CASE WHEN multi THEN side ELSE 0 END AS col, side, cell, multi, i FROM m
    UNION ALL SELECT doc_id, 0, -1, 0, 0, '{BAND}', multi, -1 FROM m WHERE i = 0 AND doc_id % 7 = 0),
  l AS (SELECT doc_id, page, col, line, string_agg(cell, ' ' ORDER BY side) AS text FROM b GROUP BY ALL),
  t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page, col, line) AS text FROM l GROUP BY doc_id),
  s AS (SELECT doc_id, string_agg(cell, ' ' ORDER BY i) AS stream, count(DISTINCT page) AS pages, count(DISTINCT page) FILTER (multi) AS multi_pages FROM b GROUP BY doc_id),
  laid AS (SELECT w.doc_id, coalesce(t.text, '') AS text, coalesce(stream, '') AS stream, coalesce(pages, 1) AS pages, coalesce(multi_pages, 0) AS multi_pages
    FROM w LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id))"""


@query(f"""
WITH {_LAID}
SELECT doc_id, 'pdf' AS format, pages, CASE WHEN text = '' THEN 0 ELSE len(regexp_split_to_array(text, '[ \\n]')) END AS words, multi_pages, md5(text) AS text_md5, md5(stream) AS stream_md5
FROM laid""")
def q32_pdf_layout(spark, sf_dir):
    """Documents set as PDF, every third in two columns line by line, read back column by column.

    Even ones are compressed, every fourth has its cross-reference table misplaced, every
    seventh a telephone number at the top, and those without words are an image.
    """
    rows = api.parsed(_rendered(spark, sf_dir, _pdf_of, "pdf"), api.LAID_OUT).filter("status = 'ok'")
    stream = F.regexp_replace("stream_text", "\n", " ")
    return api.layout.extract_text(rows, also=[F.size("multi_column_pages").cast("long").alias("multi_pages"), F.md5(stream).alias("stream_md5")]).select(
        "doc_id", "format", F.col("pages").cast("long").alias("pages"), "words", "multi_pages", F.md5("text").alias("text_md5"), "stream_md5"
    )


@query(f"""
WITH {_LAID}, found AS ({_FINDINGS.replace(_FLAGS, _FLAGS.replace("FROM documents", "FROM laid"))})
SELECT doc_id, id, severity FROM found JOIN laid USING (doc_id) WHERE text <> ''
UNION ALL SELECT doc_id, 'scanned_no_text', 'blocker' FROM laid WHERE text = ''
UNION ALL SELECT doc_id, 'multi_column', 'high' FROM laid WHERE multi_pages > 0
UNION ALL SELECT doc_id, 'order_dependent', 'high' FROM laid WHERE stream <> replace(text, chr(10), ' ')
UNION ALL SELECT doc_id, 'x_contact_in_pdf_band', 'medium' FROM laid WHERE text <> '' AND doc_id % 7 = 0
UNION ALL SELECT doc_id, 'x_contact_in_annotation', 'medium' FROM laid WHERE doc_id % 5 = 0""")
def q33_pdf_findings(spark, sf_dir):
    """Findings of the documents set as PDF; every fifth has an address only behind a link."""
    rows = api.parsed(_rendered(spark, sf_dir, _pdf_of, "pdf"), api.LAID_OUT).filter("status = 'ok'")
    return lint.findings(rows).select("doc_id", "id", "severity")


_ACHIEVED = ("Raised the yield of line {n} by {n} percent", "Brought {n} plants under one plan", "Closed the books {n} days sooner", "Won {n} tenders in a row")
_MONTHS = (("Northwind", "March 2020 - Present"), ("Contoso", "June 2015 - February 2020"))
_DUTIES = (
    ("Led the planning of all northern works", "Bought machines for seven of the works", "Trained crews in the new method", "Kept the maintenance ledger of every site"),
    ("Drew up budgets for three sites", "Answered for safety at the harbour", "Set quality targets with both suppliers", "Negotiated freight contracts along the western coast"),
)
#: Lines of the résumé besides the paragraphs that hold the document's words.
_LINES = 35


def _summarised(parts: list[str]) -> list[tuple[str, dict]]:
    return [(f"Summary {i} {part}".strip(), {}) for i, part in enumerate(parts)]


def _resume(variant: int, parts: list[str]) -> list[tuple[str, dict]]:
    """(text, formatting) of each paragraph; ``variant`` names the one thing that is wrong, 0 nothing."""
    head = {"size": 12, "bold": variant != 11, "rule": True}
    bullet = {"level": 1 if variant == 21 else 0}
    contact = "Hull, England , +44 20 7946 0958 , mara@example.org" if variant == 8 else "Hull, England | +44 20 7946 0958 | mara@example.org"
    rows = [("Mara Lind", {"size": 14 if variant == 7 else 18, "bold": True}), ("Head of Works", {"size": 12, "color": "FF0000" if variant == 24 else "808080"}), (contact, {})]
    rows.append(("linkedin.com/in/mara", {"link": variant != 22}))
    rows += [("PROFESSIONAL SUMMARY", head)] + _summarised(parts)
    rows += [("CORE COMPETENCIES", head)] + [(f"Planning {i} {',' if variant == 25 else '|'} Budget {i}", {}) for i in range(3)]
    achieved = [x.format(n="" if variant == 14 else 11 + i).replace("  ", " ") for i, x in enumerate(_ACHIEVED)]
    if variant == 6:
        achieved = ["• " + x for x in achieved]
    rows += [("KEY ACHIEVEMENTS", head)] + [(x, {} if variant == 6 else bullet) for x in achieved[variant == 13 :]]
    rows.append(("PROFESSIONAL EXPERIENCE", head))
    roles = list(zip(("Head of Works", "Works Manager"), _MONTHS, _DUTIES, strict=True))
    for title, (company, span), duties in roles[:: -1 if variant == 19 else 1]:
        company = f"{company} | {span}" if variant != 15 else f"{company}, {span}"
        rows += [(title, {"size": 11, "bold": variant != 28}), (company, {"italic": variant != 29})]
        rows += [(x, bullet) for x in duties[variant == 18 :]]
    rows += [("EARLIER CAREER", head), ("Clerk at Litware" if variant == 26 else "Clerk, Litware (2010 - 2015)", bullet)]
    rows += [("EDUCATION", head)] * (variant != 9) + [("BSc Physics, Hull (2006 - 2009)", bullet)]
    last = [[("TECHNOLOGY", head), ("Ledger | Planner", {"size": 9 if variant == 20 else 10})], [("LANGUAGES", head), ("English | Danish", {"font": "Arial" if variant == 27 else ""})]]
    return rows + [x for part in last[:: -1 if variant == 10 else 1] for x in part]


#: Paragraphs before those that hold the document's words.
_BEFORE = 5


def _summary(variant: int, text: str) -> list[str]:
    """The paragraphs that hold the document's words."""
    words, n = _WORD.findall(text), 2 if variant == 12 else 3
    parts = [" ".join(words[i * len(words) // n : (i + 1) * len(words) // n]) for i in range(n)]
    return [t for t, _ in _summarised(parts)]


@functools.cache
def _fixed_xml(variant: int) -> list[str]:
    """The other paragraphs, which are the same for all documents of a variant."""
    return [compose.paragraph(t, **kind) for t, kind in _resume(variant, [])]


def _docx_of(doc_id: int, text: str) -> bytes:
    """Every thirty-first file is cut in the middle."""
    variant = doc_id % 32
    fixed = _fixed_xml(variant)
    body = [*fixed[:_BEFORE], *map(compose.paragraph, _summary(variant, text)), *fixed[_BEFORE:]]
    body += {3: [compose.text_table("Skills")], 4: [compose.picture()], 30: [compose.text_box()]}.get(variant, [])
    data = compose.docx(
        body, (12240, 15840) if variant == 23 else (11906, 16838), (2.4, 1.7) if variant == 1 else (1.5, 1.7), 2 if variant == 2 else 1,
        "" if variant == 17 else "Mara Lind", "resume" if variant == 16 else "Mara Lind - Head of Works - CV", "Page" if variant == 5 else "", "Page" if variant == 31 else "",
    )
    return data[: len(data) // 2] if doc_id % 31 == 7 else data


def _lines(texts: list[str]) -> list[str]:
    return [" ".join(words[i : i + 10]) for words in (t.split(" ") for t in texts) for i in range(0, len(words), 10)]


@functools.cache
def _fixed_lines(variant: int, whole: bool) -> tuple[list[str], list[str]]:
    fixed = [t for t, _ in _resume(variant, [])]
    return _lines(fixed[:_BEFORE]), _lines([t for t in fixed[_BEFORE:] if whole or not t.startswith("Negotiated")])


def _pdf_of_resume(doc_id: int, text: str) -> bytes:
    """The same paragraphs as PDF in lines of ten words; every third lacks a duty, and every thirty-seventh is no PDF."""
    if doc_id % 37 == 5:
        return b"%PDF-1.4 " + text.encode()[:99].replace(b"obj", b"")
    before, after = _fixed_lines(doc_id % 32, doc_id % 3 != 2)
    lines = [*before, *_lines(_summary(doc_id % 32, text)), *after]
    return compose.pdf([[(40, 730 - 13 * i, 8, line) for i, line in enumerate(lines[at : at + ROWS])] for at in range(0, len(lines), ROWS)])


#: What each variant must fail, and what then cannot be judged.
_WRONG = {
    1: "page.margins", 2: "page.columns", 3: "no.tables", 4: "no.images", 5: "no.header", 6: "bullets.real", 7: "header.name", 8: "header.contact",
    9: "sections.present", 10: "sections.order", 11: "sections.formatting", 12: "summary.shape", 13: "achievements.count", 14: "achievements.quantified",
    15: "experience.roles", 16: "meta.title", 17: "meta.author", 18: "x_experience.bullets", 19: "x_experience.order", 20: "x_body.size", 21: "x_bullets.level",
    22: "header.linkedin", 23: "x_page.size", 24: "x_header.headline", 25: "x_competencies.shape", 26: "x_lines.shape", 27: "x_font", 28: "x_experience.title_format",
    29: "experience.company_format", 30: "x_no.textboxes", 31: "x_no.footer",
}
#: Without company lines, roles are not told apart: all lines are titles, none has a month.
_FURTHER = "(15, 'x_experience.title_format', 'fail'), (15, 'experience.company_format', 'skip'), (15, 'x_experience.bullets', 'skip'), (15, 'x_experience.order', 'skip')"
_IDS = "x_page.size page.margins page.columns no.tables x_no.textboxes no.images no.header x_no.footer bullets.real x_bullets.level x_font header.name x_header.headline header.contact header.linkedin sections.present sections.order sections.formatting summary.shape x_competencies.shape achievements.count achievements.quantified experience.roles experience.company_format x_experience.bullets x_experience.order x_experience.title_format x_body.size x_lines.shape meta.author meta.title".split()
_RENDERED = f"""
  wrong(variant, id, status) AS (VALUES {", ".join(f"({v}, '{i}', 'fail')" for v, i in _WRONG.items())}, {_FURTHER}),
  ids AS (SELECT unnest([{", ".join(f"'{i}'" for i in _IDS)}]) AS id),
  d AS (SELECT doc_id, doc_id % 32 AS variant, doc_id % 3 AS pdf, len(regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}')) AS n, CASE WHEN doc_id % 32 = 12 THEN 2 ELSE 3 END AS parts FROM documents),
  s AS (SELECT doc_id, sum((2 + (k + 1) * n // parts - k * n // parts + 9) // 10) AS lines FROM d, unnest(range(parts)) u(k) GROUP BY doc_id),
  r AS (SELECT doc_id, variant, pdf, doc_id % 31 = 7 AS bad, pdf <> 0 AND doc_id % 37 = 5 AS bad_pdf,
    (lines + {_LINES} - CASE WHEN variant IN (9, 13) THEN 1 WHEN variant = 18 THEN 2 ELSE 0 END - CASE WHEN pdf = 2 THEN 1 ELSE 0 END + {ROWS - 1}) // {ROWS} AS pages FROM d JOIN s USING (doc_id)),
  checks AS (
    SELECT doc_id, id, CASE WHEN bad THEN 'skip' ELSE coalesce(status, 'pass') END AS status FROM r CROSS JOIN ids LEFT JOIN wrong USING (variant, id)
    UNION ALL SELECT doc_id, 'x_docx.readable', CASE WHEN bad THEN 'fail' ELSE 'pass' END FROM r
    UNION ALL SELECT doc_id, 'x_pdf.readable', CASE WHEN pdf = 0 THEN 'skip' WHEN bad_pdf THEN 'fail' ELSE 'pass' END FROM r
    UNION ALL SELECT doc_id, 'parity.docx_pdf', CASE WHEN bad OR bad_pdf OR pdf = 0 THEN 'skip' WHEN pdf = 1 THEN 'pass' ELSE 'fail' END FROM r
    UNION ALL SELECT doc_id, unnest(['pdf.single_column', 'x_pdf.blockers']), CASE WHEN bad_pdf OR pdf = 0 THEN 'skip' ELSE 'pass' END FROM r
    UNION ALL SELECT doc_id, 'x_pdf.pages', CASE WHEN bad_pdf OR pdf = 0 THEN 'skip' WHEN pages <= 2 THEN 'pass' ELSE 'fail' END FROM r
    UNION ALL SELECT doc_id, unnest(['x_jd.required', 'x_jd.gates']), 'skip' FROM r)"""


def _resumes(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document as a résumé in DOCX, 31 of 32 with a fault; two in three have a PDF, half of those with a duty left out.

    Some files of either kind cannot be read at all.
    """
    files = _rendered(spark, sf_dir, _docx_of, "docx")
    pdfs = _rendered(spark, sf_dir, _pdf_of_resume, "pdf", "doc_id % 3 <> 0")
    return files, pdfs


@query(f"WITH {_RENDERED} SELECT doc_id, id, status FROM checks")
def q34_docx_gate(spark, sf_dir):
    return api.validate(*_resumes(spark, sf_dir)).select("doc_id", "id", gate.status(F.col("ok")).alias("status"))


@query(f"""
WITH {_RENDERED}, v AS (
  SELECT doc_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'fail') AS n_fail, count(*) FILTER (status = 'skip') AS n_skip,
    count(*) FILTER (status = 'fail' AND id LIKE '%.readable') AS unread FROM checks GROUP BY doc_id)
SELECT doc_id, n_pass, n_fail, n_skip, floor((200 * n_pass + n_pass + n_fail) / (2 * (n_pass + n_fail)))::INT AS score, n_fail = 0 AND n_pass > 0 AS passed,
  CASE WHEN unread > 0 THEN 2 WHEN n_fail = 0 THEN 0 ELSE 1 END AS exit_code FROM v""")
def q35_gate_verdict(spark, sf_dir):
    return api.verdicts(*_resumes(spark, sf_dir))


#: Specifications of owners, as JSON: (owner, version, spec). Later versions count key by key; a value of another kind does not.
_SPECS = (
    ("en", 1, '{"summary_paragraphs": 2, "font": "Arial"}'), ("en", 2, '{"font": "Calibri", "body_pt": null}'), ("de", 1, '{"heading_pt": 13, "page_w": "wide"}'),
    ("fr", 7, '{"author": "Someone Else"}'), ("es", 1, '{"contact_exact": "Hull, England | +44 20 7946 0958 | mara@example.org", "no such key": 1}'), ("nobody", 1, '{"columns": 9}'),
)


@query(f"""
WITH {_RENDERED}, o AS (SELECT c.doc_id, c.id, lang, doc_id % 32 AS variant, CASE WHEN id = 'x_docx.readable' OR id IN (SELECT id FROM ids) THEN status ELSE 'skip' END AS status FROM checks c JOIN documents USING (doc_id))
SELECT doc_id, id, CASE WHEN status = 'skip' THEN 'skip' WHEN lang = 'en' AND id = 'summary.shape' THEN CASE WHEN variant = 12 THEN 'pass' ELSE 'fail' END
  WHEN lang = 'de' AND id = 'sections.formatting' OR lang = 'fr' AND id = 'meta.author' THEN 'fail' ELSE status END AS status FROM o""")
def q40_owner_specs(spark, sf_dir):
    """The gate with specifications of owners, who are the documents' languages here."""
    files = _rendered(spark, sf_dir, _docx_of, "docx")
    owners = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("owner"))
    specs = spark.createDataFrame(_SPECS, "owner string, version int, spec string").withColumn("spec", F.parse_json("spec"))
    return api.validate(files.join(owners, "doc_id"), specs=specs).select("doc_id", "id", gate.status(F.col("ok")).alias("status"))
