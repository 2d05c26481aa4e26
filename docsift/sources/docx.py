"""Formatting model of DOCX files: paragraphs, section, properties and what is stranded outside.

Run properties resolve as the format prescribes: the run's own, then its paragraph style and
what that is based on, then the document's defaults.
"""

from __future__ import annotations

import functools
import io
import zipfile
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Twentieths of a point in a centimetre.
TWIPS_PER_CM = 566.93
#: Most bytes that a part may unpack to.
MAX_PART = 64 << 20
#: Bytes below which a parsed part is kept for the next file.
SMALL_PART = 4096
GLYPHS = "•◦▪▫‣●○■□–*·"


class DocxError(ValueError):
    """The bytes are not a DOCX that can be read."""


@dataclass
class Para:
    p_no: int
    text: str
    size_pt: float | None
    bold: bool
    italic: bool
    color: str | None
    font: str | None
    is_bullet: bool
    ilvl: int
    glyph_bullet: bool
    has_bottom_rule: bool
    is_hyperlink: bool


@dataclass
class Model:
    paras: list[Para] = field(default_factory=list)
    page_w: int | None = None
    page_h: int | None = None
    mt: float | None = None
    mb: float | None = None
    ml: float | None = None
    mr: float | None = None
    n_cols: int = 1
    tables: int = 0
    textboxes: int = 0
    images: int = 0
    header_text: str = ""
    footer_text: str = ""
    author: str = ""
    title: str = ""
    hidden_text: str = ""


@functools.lru_cache(64)
def _shared(part: bytes):
    return ElementTree.fromstring(part)


@functools.lru_cache(4096)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(element) -> str:
    return _local(element.tag)


_SIZE, _COLOR, _FONTS, _BOLD, _ITALIC, _HIDDEN = (W + x for x in ("sz", "color", "rFonts", "b", "i", "vanish"))
_VAL, _ASCII, _RUN, _RUN_PROPS, _NUMBERING, _BORDERS = (W + x for x in ("val", "ascii", "r", "rPr", "numPr", "pBdr"))
#: What paragraphs are mostly made of; none of it is counted or linked.
_USUAL = frozenset(W + x for x in ("p", "pPr", "numPr", "ilvl", "numId", "rPr", "sz", "t"))
#: With these, a paragraph is text with formatting and nothing else.
_TEXTUAL = _USUAL | {W + x for x in ("r", "b", "i", "color", "rFonts", "pBdr", "bottom", "pStyle")}
_PARA_PROPS, _STYLE, _TEXT = W + "pPr", W + "pStyle", W + "t"
_BOTTOM = f"{_BORDERS}/{W}bottom"
_OFF = ("0", "false", "none", "off")


def _settings(props) -> dict:
    """Run properties that an element sets, by tag; of several with one tag the first."""
    out: dict = {}
    for x in () if props is None else props:
        tag = x.tag
        if tag in out:
            continue
        if tag == _SIZE or tag == _COLOR:
            out[tag] = x.get(_VAL)
        elif tag == _FONTS:
            out[tag] = x.get(_ASCII)
        elif tag == _BOLD or tag == _ITALIC or tag == _HIDDEN:
            out[tag] = x.get(_VAL, "true") not in _OFF
    return out


def _value(props, tag: str, attribute: str = "val") -> str | None:
    found = None if props is None else props.find(W + tag)
    return None if found is None else found.get(W + attribute)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data = data
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.zip.namelist())
        except (zipfile.BadZipFile, OSError, ValueError) as wrong:
            raise DocxError("not a zip") from wrong
        if "word/document.xml" not in self.names:
            raise DocxError("no word/document.xml in it")
        self.styles: dict[str, tuple[str | None, object, object]] = {}
        self.defaults = None
        self.resolved: dict[str | None, dict] = {}
        styles = self._xml("word/styles.xml")
        if styles is not None:
            default = styles.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr")
            self.defaults = default
            for s in styles.findall(W + "style"):
                self.styles[s.get(W + "styleId", "")] = (_value(s, "basedOn"), s.find(W + "rPr"), s.find(W + "pPr"))
        self.external = set()
        rels = self._xml("word/_rels/document.xml.rels")
        if rels is not None:
            self.external = {x.get("Id") for x in rels if x.get("Type", "").endswith("/hyperlink") and x.get("Target")}

    def _part(self, name: str) -> bytes:
        """A part's bytes; by way of ``zipfile`` if it is not plainly stored or deflated, or damaged."""
        info = self.zip.getinfo(name)
        at = info.header_offset
        if self.data[at : at + 4] == b"PK\x03\x04" and not info.flag_bits & 1 and info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            at += 30 + int.from_bytes(self.data[at + 26 : at + 28], "little") + int.from_bytes(self.data[at + 28 : at + 30], "little")
            part = self.data[at : at + info.compress_size]
            try:
                part = zlib.decompressobj(-15).decompress(part, info.file_size + 1) if info.compress_type else part
            except zlib.error:
                part = b""
            if len(part) == info.file_size and zlib.crc32(part) == info.CRC:
                return part
        return self.zip.read(name)

    def _xml(self, name: str):
        if name not in self.names:
            return None
        if self.zip.getinfo(name).file_size > MAX_PART:
            raise DocxError(f"{name} is too large")
        try:
            part = self._part(name)
            # styles and the like are the same in many files of one origin
            return _shared(part) if len(part) < SMALL_PART and name != "word/document.xml" else ElementTree.fromstring(part)
        except (ElementTree.ParseError, zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError) as wrong:
            raise DocxError(f"{name} cannot be read") from wrong

    def _chain(self, style: str | None, part: int) -> list:
        out, seen = [], set()
        while style in self.styles and style not in seen:
            seen.add(style)
            out.append(self.styles[style][part])
            style = self.styles[style][0]
        return [x for x in out if x is not None]

    def _inherited(self, style: str | None) -> dict:
        """Run properties of a paragraph style, of what it is based on and of the defaults; worked out once."""
        if style not in self.resolved:
            found: dict = {}
            for props in [*self._chain(style, 1), self.defaults]:
                found |= {k: v for k, v in _settings(props).items() if v is not None and k not in found}
            self.resolved[style] = found
        return self.resolved[style]

    def model(self) -> Model:
        model = Model()
        body = self._xml("word/document.xml").find(W + "body")
        if body is None:
            raise DocxError("no body")
        self._walk(body, model)
        for section in body.iter(W + "sectPr"):
            self._section(section, model)
        for kind in ("header", "footer"):
            parts = sorted(n for n in self.names if n.startswith(f"word/{kind}") and n.endswith(".xml"))
            texts = ["".join(t.text or "" for t in self._xml(n).iter(W + "t")) for n in parts]
            setattr(model, f"{kind}_text", "\n".join(t for t in texts if t.strip()))
        core = self._xml("docProps/core.xml")
        for element in [] if core is None else core:
            if _name(element) == "creator":
                model.author = (element.text or "").strip()
            elif _name(element) == "title":
                model.title = (element.text or "").strip()
        return model

    def _walk(self, parent, model: Model) -> None:
        for child in parent:
            kind = _local(child.tag)
            if kind == "p":
                self._para(child, model)
            elif kind == "tbl":
                model.tables += 1
                self._walk(child, model)
            elif kind in ("tr", "tc", "sdt", "sdtContent", "ins", "smartTag", "customXml"):
                self._walk(child, model)

    def _section(self, section, model: Model) -> None:
        size, margin, columns = (section.find(W + x) for x in ("pgSz", "pgMar", "cols"))
        number = lambda e, a: None if e is None or e.get(W + a) is None else float(e.get(W + a))
        w, h = number(size, "w"), number(size, "h")
        model.page_w, model.page_h = (None if w is None else int(w)), (None if h is None else int(h))
        for name, side in (("mt", "top"), ("mb", "bottom"), ("ml", "left"), ("mr", "right")):
            value = number(margin, side)
            setattr(model, name, None if value is None else round(value / TWIPS_PER_CM, 2))
        n = number(columns, "num")
        model.n_cols = max(model.n_cols, int(n) if n else 1)

    def _para(self, p, model: Model) -> None:
        props = p.find(_PARA_PROPS) if len(p) > 1 else None
        named = None if props is None else props.find(_STYLE)
        style = (None if named is None else named.get(_VAL)) or ("Normal" if "Normal" in self.styles else None)
        texts: list[str] = []
        first = None
        linked = False
        boxes, runs = [], []
        tags = {x.tag for x in p.iter()}
        plain = tags <= _TEXTUAL
        if plain:
            runs = list(p.iter(_RUN))
        for element in () if plain else p.iter():
            tag = element.tag
            if tag in _USUAL:
                continue
            if tag == _RUN:
                runs.append(element)
                continue
            kind = _local(tag)
            if kind == "hyperlink":
                linked = linked or element.get(R + "id") in self.external
            elif kind == "txbxContent":
                boxes.append(element)
            elif kind in ("drawing", "pict") and not any(_name(x) == "txbxContent" for x in element.iter()):
                model.images += 1
        inside = {id(x) for box in boxes for x in box.iter()} if boxes else ()
        for run in runs:
            if inside and id(run) in inside:
                continue
            own, text = None, ""
            for x in run:
                tag = x.tag
                if tag == _TEXT:
                    text += x.text or ""
                    continue
                if tag == _RUN_PROPS:
                    own = x if own is None else own
                    continue
                kind = _local(tag)
                if kind == "t":
                    text += x.text or ""
                elif kind == "tab":
                    text += "\t"
                elif kind in ("br", "cr"):
                    text += "\n"
            if not plain and own is not None and len(own) and own.find(_HIDDEN) is not None and _settings(own)[_HIDDEN]:
                model.hidden_text += text
                continue
            if first is None and text.strip():
                first = own if own is not None else run
            texts.append(text)
        text = "".join(texts).strip()
        if text:
            own = _settings(first)
            if None in own.values():
                own = {k: v for k, v in own.items() if v is not None}
            pick = (self._inherited(style) | own if own else self._inherited(style)).get
            size = pick(_SIZE)
            number = None
            border = None
            holders = () if props is None else (props,)
            for holder in (*holders, *self._chain(style, 2)) if style else holders:
                number = holder.find(_NUMBERING) if number is None else number
                border = holder.find(_BOTTOM) if border is None and holder.find(_BORDERS) is not None else border
            bullet = number is not None and _value(number, "numId") not in (None, "0")
            model.paras.append(
                Para(
                    len(model.paras) + 1, text, float(size) / 2 if size else None, bool(pick(_BOLD)), bool(pick(_ITALIC)),
                    pick(_COLOR), pick(_FONTS), bullet,
                    int(_value(number, "ilvl") or 0) if bullet else 0, not bullet and text[0] in GLYPHS and text[1:2].isspace(),
                    border is not None and border.get(W + "val", "single") not in ("nil", "none"), linked,
                )
            )
        for box in boxes:
            model.textboxes += 1
            self._walk(box, model)
