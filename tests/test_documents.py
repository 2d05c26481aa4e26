import pytest

from docsift.operators import layout, lint
from docsift.plans import api
from docsift.sources import documents
from docsift.sources.docx import DocxError, Reader
from docsift.sources.pdf import MAX_OPERATIONS, Document, PdfError, _lzw
from docsift.sources.rtf import rtf_text
from tests import fixtures as fx


def spans_text(data):
    return " ".join(s.text for p in Document(data).pages() for s in p.spans)


@pytest.mark.parametrize("style", ["table", "stream", "objstm", "broken"])
@pytest.mark.parametrize("compress", ["", "flate", "hex", "a85"])
def test_pdf_containers(style, compress):
    text = spans_text(fx.pages_pdf([fx.content_of(fx.RESUME)], style, compress))
    assert "Tove Harkness" in text and "steam bending" in text and "(refits of sixty" in text


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00640061> endbfchar 1 beginbfrange <0003> <0005> <0078> endbfrange"


def type0(with_map):
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Odd /Encoding /Identity-H %s >>" % (b"/ToUnicode 8 0 R" if with_map else b"")
    more = {8: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(CMAP), CMAP)} if with_map else {}
    return fx.pages_pdf([b"BT /F1 10 Tf 50 700 Td <000100020003000400050009> Tj ET"], font=font, more=more)


def test_fonts():
    assert spans_text(type0(True)) == "Adaxyz�"
    assert spans_text(type0(False)) == "������"


def test_forms_images_and_links():
    form = b"BT /F1 9 Tf 10 20 Td [(In) -300 (side)] TJ ET /Fm Do"
    more = {
        40: b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 100 200] /Length %d >>\nstream\n%s\nendstream" % (len(form), form),
        41: b"<< /Type /XObject /Subtype /Image /Length 3 >>\nstream\nabc\nendstream",
        42: b"<< /Type /Annot /A << /URI (mailto:ada@example.org) >> >>",
    }
    page = Document(fx.pages_pdf([b"/Fm Do /Im Do"], more=more, resources=b"/XObject << /Fm 40 0 R /Im 41 0 R >>", page=b"/Annots [42 0 R]")).pages()[0]
    assert (page.spans[0].text, page.spans[0].x, page.spans[0].y) == ("In side", 110, 220)
    assert page.images == 1 and page.mailto == ["ada@example.org"]


def test_operations_are_bounded():
    doc = Document(fx.pages_pdf([b"q Q " * MAX_OPERATIONS], compress="flate"))
    doc.pages()
    assert doc.operations == MAX_OPERATIONS + 1


def test_lzw():
    # clear, a, b, (ab), end in nine-bit codes
    codes = [256, 97, 98, 258, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert _lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"abab"


@pytest.mark.parametrize("data", [b"%PDF-1.4\nnothing here\n%%EOF", b"no pdf", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 1 0 R >>\nendobj", b"%PDF" + b"<<" * 5000])
def test_garbage_pdf(data):
    try:
        assert Document(data).pages() == []
    except PdfError:
        pass


def test_docx_model():
    m = Reader(fx.canonical_docx()).model()
    assert len(m.paras) == len(fx.canonical()) and m.author == "Tove Harkness" and (m.mt, m.ml, m.n_cols) == (1.5, 1.7, 1)
    assert m.paras[0].size_pt == 18 and m.paras[0].bold and m.paras[3].is_hyperlink and m.paras[4].has_bottom_rule
    styled = Reader(fx.docx(fx.para("styled", size=0, style="Small"))).model().paras[0]
    assert (styled.size_pt, styled.italic, styled.font) == (7.0, True, "Calibri")
    with pytest.raises(DocxError):
        Reader(b"this is not a zip")


def test_docx_outside_the_body():
    box = f'<w:p><w:r><w:pict><v:shape xmlns:v="urn:schemas-microsoft-com:vml"><v:textbox><w:txbxContent>{fx.para("In a box")}</w:txbxContent></v:textbox></v:shape></w:pict></w:r></w:p>'
    hidden = "<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret words</w:t></w:r><w:r><w:t>shown</w:t></w:r></w:p>"
    m = Reader(fx.docx(fx.para("Body") + f"<w:tbl><w:tr><w:tc>{fx.para('Cell')}</w:tc></w:tr></w:tbl>" + box + hidden, header="ada@example.org")).model()
    assert [p.text for p in m.paras] == ["Body", "Cell", "In a box", "shown"]
    assert (m.tables, m.textboxes, m.images, m.hidden_text) == (1, 1, 0, "secret words") and "ada@" in m.header_text


def test_rtf():
    assert rtf_text(rb"{\rtf1{\fonttbl{\f0 Arial;}}\b Ada\b0  Verne\par caf\'e9 \u8364?5 {\*\x hid}a\{b\}}") == "Ada Verne\ncafé €5 a{b}"


def files(spark, rows):
    return spark.createDataFrame([(i, n, bytearray(d)) for i, (n, d) in enumerate(rows)], "doc_id long, filename string, content binary")


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [
        ("good.pdf", fx.pages_pdf([fx.content_of(fx.RESUME)], compress="flate")),
        ("two.pdf", fx.pages_pdf([fx.content_of(fx.TWO_COLUMNS)])),
        ("scan.pdf", fx.pages_pdf([b"/Im Do"], resources=b"/XObject << /Im 41 0 R >>", more={41: b"<< /Subtype /Image /Length 3 >>\nstream\nabc\nendstream"})),
        ("odd.pdf", type0(False)),
        ("a.docx", fx.docx(fx.para("WORK EXPERIENCE") + fx.para("Engineer, Northwind 2019 - 2023"), header="ada@example.org | +44 20 7946 0958")),
        ("x/notes.TXT", "Ada Verne\r\nada@example.org".encode()),
        ("b.docx", b"this is not a zip"), ("c.pages", b"PK\x03\x04x"), ("d.pdf", b""), ("e.pdf", b"%PDF-1.4\nnothing\n%%EOF"), ("f.rtf", rb"{\rtf1 plain rtf}"), ("g.md", b"# Title"),
    ]
    return api.load(files(spark, rows)).cache()


def test_formats_and_errors(loaded):
    rows = {r.filename: r for r in loaded.collect()}
    assert {n: (r.kind, r.status) for n, r in rows.items() if r.status == "ok"} == {
        "good.pdf": ("pdf", "ok"), "two.pdf": ("pdf", "ok"), "scan.pdf": ("pdf", "ok"), "odd.pdf": ("pdf", "ok"), "a.docx": ("docx", "ok"), "notes.TXT": ("text", "ok"), "f.rtf": ("rtf", "ok"), "g.md": ("markdown", "ok"),
    }
    assert rows["b.docx"].error_class == "UnsupportedFormat" and "Export to PDF" in rows["c.pages"].message
    assert rows["d.pdf"].error_class == "UnsupportedFormat" and rows["e.pdf"].error_class == "PdfError"
    assert {r.exit_code for r in api.errors(loaded).collect()} == {2}


def test_layout(loaded):
    rows = {r.filename: r for r in loaded.collect()}
    two, good = rows["two.pdf"], rows["good.pdf"]
    assert two.multi_column and two.multi_column_pages == [1] and not good.multi_column
    assert "Esk Slipway\nforeman" in two.text and "SKILLS\nLofting" in two.text
    assert "EMPLOYMENT KEY SKILLS" in two.stream_text
    assert "(refits of sixty cobles and two lifeboats) 2012 - 2024" in good.text
    assert good.n_pages == 1 and good.n_words == len(good.text.split())
    by = {r.filename: r for r in layout.extract_text(loaded.filter("kind = 'pdf'"), stream_order=True).collect()}
    assert by["two.pdf"].order == "content-stream" and "EMPLOYMENT KEY SKILLS" in by["two.pdf"].text


def test_lint(loaded):
    found: dict = {}
    names = {r.doc_id: r.filename for r in loaded.collect()}
    for r in api.all_findings(loaded.filter("status = 'ok'")).collect():
        found.setdefault(names[r.doc_id], {})[r.id] = r.severity
    good = found.get("good.pdf", {})
    assert "blocker" not in good.values() and not {"no_email", "no_phone", "missing_sections", "no_dates", "no_date_ranges"} & set(good)
    assert found["scan.pdf"]["scanned_no_text"] == "blocker" and "no_email" not in found["scan.pdf"]
    assert {"multi_column", "order_dependent"} <= set(found["two.pdf"])
    assert found["odd.pdf"]["unmapped_glyphs"] == "blocker"
    assert "contact_in_docx_header" in found["a.docx"]
    scores = {names[r.doc_id]: r for r in lint.score(loaded, lint.findings(loaded)).collect()}
    assert scores["good.pdf"].score >= 85 and scores["scan.pdf"].blockers == 1
    inline = {names[r.doc_id]: r for r in lint.score_inline(loaded).collect()}
    assert inline == scores


def test_more_findings(spark):
    rows = [(1, "Ada 'been there 'since '09 - '12\nSTRANGE PART\n" + "word " * 60, "secret", None), (2, "no contact", None, "ada@example.org"), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hidden_text string, mailto string")
    ids = {}
    for r in api.all_findings(docs).collect():
        ids.setdefault(r.doc_id, set()).add(r.id)
    assert {"x_odd_dates", "x_odd_headings", "x_hidden_text", "x_keyword_stuffing"} <= ids[1]
    assert "x_contact_in_annotation" in ids[2]
    assert lint.score(docs, lint.findings(docs)).filter("doc_id = 3").first().score < 100


def test_extract_from_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "cv.PDF").write_bytes(fx.pages_pdf([fx.content_of(fx.RESUME)]))
    (tmp_path / "in" / "big.txt").write_bytes(b"x" * 5000)
    path = f"file://{tmp_path}/in"
    read = documents.read_files(spark, path, most_bytes=4000)
    assert [r.filename for r in api.extract(read).collect()] == ["cv.PDF"]
    assert [r.error_class for r in documents.oversize_files(spark, path, 4000).collect()] == ["InputTooLarge"]
    plan = read.select("filename")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_what_a_reader_cuts_is_said_and_found(spark, monkeypatch):
    from docsift.sources import pdf

    whole = fx.pages_pdf([fx.content_of(fx.RESUME)] * 3, "table", "flate")
    assert documents.parse_one("a.pdf", whole)["truncated"] is None
    for name, value, said in (("MAX_OPERATIONS", 5, "more than 5 operations"), ("MAX_PAGES", 2, "more than 2 pages"), ("MAX_STREAM", 10, "a stream has more"), ("MAX_TREE", 0, "levels")):
        with monkeypatch.context() as m:
            m.setattr(pdf, name, value)
            assert said in documents.parse_one("a.pdf", whole)["truncated"], name
    broken = fx.pages_pdf([fx.content_of(fx.RESUME)] * 3).replace(b"/Length", b"/Filter /FlateDecode /Length", 1)
    assert "cannot be decoded" in documents.parse_one("a.pdf", broken)["truncated"]
    rows = spark.createDataFrame([(1, "some text", "there are more than 5 operations"), (2, "some text", None)], "doc_id long, text string, truncated string")
    found = {(r.doc_id, r.detail) for r in lint.findings(rows).filter("id = 'x_text_cut'").collect()}
    assert found == {(1, "there are more than 5 operations")}
    assert {r.doc_id: r.blockers for r in lint.with_blockers(rows).collect()} == {1: 1, 2: 0}
