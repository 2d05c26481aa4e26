"""Writers of plain PDF and DOCX files, so that known content can be sent through the readers."""

from __future__ import annotations

import functools
import io
import zipfile
import zlib
from xml.sax.saxutils import escape, quoteattr

#: A placed piece of text: x, y, size in points, text of the Latin-1 range.
Placed = tuple[float, float, float, str]
WORD_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Parts of fewer characters are not worth deflating.
SMALL = 1024
#: Size of text that sets none of its own: the defaults have it, as word processors write it.
BODY = 10
PACKAGE = "http://schemas.openxmlformats.org/package/2006"


@functools.lru_cache(4096)
def _place(x: float, y: float, size: float) -> bytes:
    return b"/F1 %g Tf 1 0 0 1 %g %g Tm" % (size, x, y)


def _show(piece: Placed) -> bytes:
    x, y, size, text = piece
    shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1", "replace")
    return b"%s (%s) Tj" % (_place(x, y, size), shown)


def pdf(pages: list[list[Placed]], packed: bool = True, image: bool = False, mailto: str = "", misplaced: int = 0) -> bytes:
    """A PDF with a page for each list; all pages show an image if ``image``, the first links to ``mailto``.

    ``misplaced`` is added to the position of the cross-reference table, which a reader
    then has to rebuild.
    """
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    bodies.append(b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 /Length 1 >>\nstream\n\x00\nendstream")
    kids = []
    for i, pieces in enumerate(pages):
        data = b"\n".join([*([b"/Im0 Do"] if image else []), b"BT", *map(_show, pieces), b"ET"])
        data = zlib.compress(data, 1) if packed else data
        note = b"/Annots [<< /Type /Annot /Subtype /Link /Rect [0 0 9 9] /A << /S /URI /URI (mailto:%s) >> >>]" % mailto.encode() if mailto and not i else b""
        kids.append(b"%d 0 R" % (len(bodies) + 1))
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im0 4 0 R >> >> %s >>" % (len(bodies) + 2, note))
        bodies.append(b"<< %s/Length %d >>\nstream\n%s\nendstream" % (b"/Filter /FlateDecode " if packed else b"", len(data), data))
    bodies[1] = b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(kids), len(kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table + misplaced))


def paragraph(text: str, size: float = BODY, bold: bool = False, italic: bool = False, color: str = "", font: str = "", level: int | None = None, rule: bool = False, link: bool = False, hidden: str = "") -> str:
    """A paragraph of one run; a bullet if it has a level. ``hidden`` follows as a run that is not shown."""
    marks = (f"<w:rFonts w:ascii={quoteattr(font)}/>" if font else "") + "<w:b/>" * bold + "<w:i/>" * italic + (f'<w:color w:val="{color}"/>' if color else "")
    marks += f'<w:sz w:val="{round(2 * size)}"/>' if size != BODY else ""
    run = f'<w:r>{f"<w:rPr>{marks}</w:rPr>" if marks else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'
    run = f'<w:hyperlink r:id="link1">{run}</w:hyperlink>' if link else run
    run += f"<w:r><w:rPr><w:vanish/></w:rPr><w:t>{escape(hidden)}</w:t></w:r>" if hidden else ""
    props = "" if level is None else f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="1"/></w:numPr>'
    props += '<w:pBdr><w:bottom w:val="single" w:sz="4"/></w:pBdr>' if rule else ""
    return f"<w:p><w:pPr>{props}</w:pPr>{run}</w:p>" if props else f"<w:p>{run}</w:p>"


def text_table(text: str) -> str:
    return f"<w:tbl><w:tr><w:tc>{paragraph(text)}</w:tc></w:tr></w:tbl>"


def text_box() -> str:
    """A text box without words in it."""
    return "<w:p><w:r><w:pict><w:txbxContent><w:p/></w:txbxContent></w:pict></w:r></w:p>"


def picture() -> str:
    return "<w:p><w:r><w:drawing/></w:r></w:p>"


def docx(body: list[str], page: tuple[int, int] = (11906, 16838), margins: tuple[float, float] = (1.5, 1.7), columns: int = 1, author: str = "", title: str = "", header: str = "", footer: str = "") -> bytes:
    """A DOCX of the given body elements; margins in cm, upright and across; the page in twentieths of a point."""
    v, h = (round(x / 2.54 * 1440) for x in margins)
    section = f'<w:sectPr><w:pgSz w:w="{page[0]}" w:h="{page[1]}"/><w:pgMar w:top="{v}" w:bottom="{v}" w:left="{h}" w:right="{h}"/><w:cols w:num="{columns}"/></w:sectPr>'
    parts = {
        "word/document.xml": f"<w:document {WORD_NS}><w:body>{''.join(body)}{section}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {WORD_NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Calibri"/><w:sz w:val="{2 * BODY}"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>',
        "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="link1" Type="{OFFICE}/hyperlink" Target="https://www.linkedin.com/" TargetMode="External"/></Relationships>',
        "docProps/core.xml": f'<c:coreProperties xmlns:c="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{escape(author)}</dc:creator><dc:title>{escape(title)}</dc:title></c:coreProperties>',
    }
    for kind, tag, text in (("header", "hdr", header), ("footer", "ftr", footer)):
        if text:
            parts[f"word/{kind}1.xml"] = f"<w:{tag} {WORD_NS}>{paragraph(text)}</w:{tag}>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, xml in parts.items():
            z.writestr(name, xml, zipfile.ZIP_STORED if len(xml) < SMALL else None)
    return out.getvalue()
