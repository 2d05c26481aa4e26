"""Page layout from spans: visual lines, columns, reading order.

A span has page_no, seq, x, y, size and text; y grows upwards and seq is the order of the
content stream. A page is laid out on its own, in time n log n of its spans.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions import text as T
from docsift.sources.pdf import Page, Span

#: Lines: difference of y as a share of the font size. Gutters: least width in points, share
#: of a page's lines that they must part, width of a character as a share of the font size.
LINE, GUTTER, SUPPORT, CHARACTER = 0.5, 24.0, 0.4, 0.5
#: Starts of columns are compared in steps of so many points.
STEP = 12.0
#: Share of a page's height above which its header band begins.
BAND = 0.94


def lines(spans: list[Span]) -> list[list[Span]]:
    """Lines of a page from the top, by gaps in y; each in the order of y, x and the content stream."""
    out: list[list[Span]] = []
    above = None
    for y, _, _, s in sorted([(-s.y, s.x, s.seq, s) for s in spans]):
        if above is None or y - above > LINE * max(s.size, 1.0):
            line = []
            out.append(line)
        line.append(s)
        above = y
    return out


def _step(x: float) -> int:
    """Half a step counts as a whole one, away from zero."""
    whole = int(min(abs(x) / STEP, 2.0**31))
    whole += abs(x) / STEP - whole >= 0.5
    return -whole if x < 0 else whole


def gutters(lined: list[list[Span]]) -> list[float]:
    """x at which a further column of a page begins, if any; lines are in the order of x."""
    support: dict[int, int] = {}
    least: dict[int, float] = {}
    for line in lined:
        if len(line) < 2:
            continue
        starts = set()
        for one, two in zip(line, line[1:]):
            if two.x - (one.x + CHARACTER * one.size * len(one.text)) >= GUTTER:
                start = _step(two.x)
                starts.add(start)
                least[start] = min(two.x, least.get(start, two.x))
        for start in starts:
            support[start] = support.get(start, 0) + 1
    return sorted(least[start] for start, n in support.items() if n >= 3 and n >= SUPPORT * len(lined))


def placed(pages: list[Page]) -> dict:
    """text, stream_text, band_text and multi_column_pages of a document.

    ``text`` is read column by column; ``stream_text`` follows the content stream, with a
    line end where y changes; ``band_text`` is what stands in the topmost part of a page.
    All are empty without spans. A document is laid out where it is parsed: its spans are there.
    """
    read, stream, band, multi = [], [], [], []
    for page in pages:
        y, top = None, BAND * page.height
        for s in page.spans:
            if stream:
                stream.append(" " if y == s.y else "\n")
            stream.append(s.text)
            y = s.y
            if y > top:
                band.append(s.text)
        lined = lines(page.spans)
        for line in lined:
            if len(line) > 1:
                line.sort(key=lambda s: (s.x, s.seq))
        starts = gutters(lined)
        if not starts:
            read += [" ".join([s.text for s in line]) for line in lined]
            continue
        multi.append(page.number)
        columns: list[list[str]] = [[] for _ in range(len(starts) + 1)]
        for line in lined:
            parts: dict[int, list[str]] = {}
            for s in line:
                parts.setdefault(sum(x <= s.x + STEP / 2 for x in starts), []).append(s.text)
            for i, texts in parts.items():
                columns[i].append(" ".join(texts))
        read += [text for column in columns for text in column]
    return {"text": "\n".join(read), "stream_text": "".join(stream), "band_text": " ".join(band), "multi_column_pages": multi}


def counted() -> dict[str, Column]:
    """Pages, images and whether any page has columns, of parsed documents."""
    return {"n_pages": F.coalesce(F.size("pages"), F.lit(1)), "multi_column": F.coalesce(F.size("multi_column_pages") > 0, F.lit(False)), "n_images": F.col("images")}


def extracted(parsed: DataFrame) -> DataFrame:
    """Parsed documents with the columns that the other operators read filled in."""
    mailto = F.get(F.flatten(F.transform("pages", lambda p: p["mailto"])), F.lit(0))
    rows = parsed.withColumns(
        {
            "stream_text": F.coalesce("stream_text", "text"),
            **counted(),
            "multi_column_pages": F.coalesce("multi_column_pages", F.array().cast("array<int>")),
            "mailto": mailto,
            "header_text": F.col("section.header_text"),
        }
    )
    return rows.withColumn("n_words", T.n_words(F.col("text")))


def extract_text(extracted_rows: DataFrame, stream_order: bool = False, also: Iterable[Column] = ()) -> DataFrame:
    """(doc_id, filename, format, pages, words, multi_column_pages, text, order) and expressions of the caller's own."""
    return extracted_rows.select(
        "doc_id", "filename", F.col("kind").alias("format"), F.col("n_pages").alias("pages"), F.col("n_words").alias("words"), "multi_column_pages",
        (F.col("stream_text") if stream_order else F.col("text")).alias("text"), F.lit("content-stream" if stream_order else "layout-aware").alias("order"), *also,
    )
