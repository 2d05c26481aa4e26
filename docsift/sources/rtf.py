"""Plain text of RTF files."""

from __future__ import annotations

import re

#: Groups that hold no text of the document.
SKIPPED = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "footnote", "generator", "themedata", "listtable", "listoverridetable", "xmlnstbl"}
BREAKS = {"par": "\n", "line": "\n", "page": "\n", "sect": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
TOKEN = re.compile(r"\\([a-z]{1,32})(-?[0-9]{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|([^\\{}\r\n]+)", re.S)


class RtfError(ValueError):
    """The bytes are not RTF."""


def rtf_text(data: bytes) -> str:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise RtfError("not RTF")
    source = data.decode("cp1252", "replace")
    out: list[str] = []
    kept: list[tuple[bool, int]] = []
    skip, width, pending = False, 1, 0
    for word, number, code, symbol, brace, text in TOKEN.findall(source):
        if brace == "{":
            kept.append((skip, width))
        elif brace == "}":
            skip, width = kept.pop() if kept else (False, 1)
        elif symbol == "*":
            skip = True
        elif word in SKIPPED:
            skip = True
        elif word == "uc":
            width = int(number or 1)
        elif skip:
            continue
        elif word == "u" and number:
            value = int(number) % 65536
            out.append(chr(value) if not 0xD800 <= value < 0xE000 else "�")
            pending = width
        elif word:
            out.append(BREAKS.get(word, ""))
        elif code:
            if pending:
                pending -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol:
            out.append({"~": " ", "_": "-", "\n": "\n"}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif text:
            out.append(text[pending:])
            pending = max(0, pending - len(text))
    return "".join(out).strip()
