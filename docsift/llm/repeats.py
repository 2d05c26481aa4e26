"""Removal of every byte that a repeated window covers, by a depth-limited radix sort.

A window is ``width`` bytes of one text. Windows are the suffixes of all texts, ordered
only that deep, most significant digit first; a group that is still together after the
last pass is a repeated window. What makes it affordable is the choice of digits:

* Pass 0. Each window has an *anchor*: of its ``gram``-byte strings the one with the
  least hash, the last of equals. The anchor depends on the window's bytes alone, so
  equal windows have equal anchors at equal offsets. Neighbouring windows share an
  anchor; such a run (a *piece*) is one row instead of a hundred.
* Each further pass cuts the pieces that are still open at fixed offsets from their
  anchor (``PASSES``), down to single windows.

A piece has a *core*, the bytes that all its windows share, and a *hull*, the bytes that
they cover together. A hull that occurs twice settles its windows as repeated, a core
that occurs once settles them as unique, and only what lies between goes on to the next
pass. Groups are sums by key, combined where rows are read, so a passage that a third
of all documents share is no larger to any task than another.

Cores and hulls are told apart by two independent 64-bit polynomial hashes.

The same search runs over words (``Windows.words``): the units are then the runs of bytes
between blanks, each by its hash, ``width`` and ``gram`` count words, and spans run from the
first byte of a word to the last of another. What the blanks between them are makes no
difference. Windows of several kinds are looked for in the same passes; the lowest bits of a
core tell them apart.

Texts are UTF-8 bytes, null counts as empty, and windows never cross texts. A text that
stands in two rows repeats as a whole. Null ids and repeated rows are rows like others;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.llm._columns import raw_text, slices
from docsift.scratch import discard, written
from docsift.session import bounded_steps

WIDTH, GRAM = 400, 200
#: Offsets from the anchor at which the passes after the first cut pieces.
PASSES = (16, 1)
#: Window starts that are looked at together; bounds memory for a text of any length.
SEGMENT = 1 << 21
#: Bytes of short texts that are looked at together.
GROUP = 1 << 15
_U = np.uint64


@dataclass(frozen=True)
class Windows:
    """Windows of ``width`` units whose anchor is the least-hashed ``gram`` units in them."""

    width: int = WIDTH
    gram: int = GRAM
    words: bool = False


#: Passages of more than 50 words.
PASSAGES = Windows(51, 16, words=True)
#: Kinds of windows that one search can look for.
_KINDS = 4


class Rolling:
    """Polynomial hashes modulo 2**64 of all substrings of a byte string."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.letters = rng.integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
        self.base = int(rng.integers(1, 1 << 62)) * 8 + 5
        self.powers = self.inverses = np.ones(1, _U)

    def prepare(self, n: int) -> None:
        if len(self.powers) <= n:
            size = 1 << (n + 1).bit_length()
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                table = np.full(size, base % (1 << 64), _U)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=_U))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.prepare(len(data))
        out = np.zeros(len(data) + 1, _U)
        letters = self.letters[data] if data.dtype == np.uint8 else _mixed(data + self.letters[0]) | _U(1)
        np.cumsum(letters * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes [start, stop), the same wherever they stand."""
        return (prefix[stop] - prefix[start]) * self.inverses[start]


_one, _two = Rolling(11), Rolling(23)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_spans(data: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte behind its last; no word crosses the ``offsets`` between texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = ~_BLANK[data]
    begins, goes_on = inside[1:] & ~inside[:-1], inside[1:] & inside[:-1]
    if offsets is not None:
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(data)]
        begins[cuts] |= goes_on[cuts]
    starts = np.flatnonzero(begins)
    # a word ends at the next blank, or where the next one begins
    blanks = np.flatnonzero(~inside[1:])
    ends = np.r_[blanks, len(data)][np.searchsorted(blanks, starts)]
    return starts, np.minimum(ends, np.r_[starts[1:], len(data)]) if len(starts) else ends


def _word_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _mixed(_one.of(prefix, starts, ends))


def units(text, words: bool) -> np.ndarray:
    """What windows count: the bytes of a text, or the hashes of its words."""
    data = np.frombuffer(text, np.uint8) if len(text) else np.zeros(0, np.uint8)
    return _word_hashes(_one.prefix(data), *word_spans(data)) if words else data


def _anchors(prefix: np.ndarray, n: int, width: int, gram: int) -> np.ndarray:
    """The anchor's place for each window of n bytes."""
    grams = n - gram + 1
    at = np.arange(grams)
    order = _mixed((prefix[gram:] - prefix[:-gram]) * _one.inverses[:grams])
    # the low bits make the last of equals the least
    order = (order & ~_U(0xFFFFFF)) | (_U(0xFFFFFF) - at.astype(_U))
    span = width - gram + 1
    blocks = -(-grams // span)
    cells = np.full(blocks * span, ~_U(0))
    cells[:grams] = order
    cells = cells.reshape(blocks, span)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - width + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    return (_U(0xFFFFFF) - (least & _U(0xFFFFFF))).astype(np.int64)


def _runs(s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of window starts, sorted and joined where they touch."""
    order = np.argsort(s1, kind="stable")
    s1, s2 = s1[order], np.maximum.accumulate(s2[order])
    new = np.r_[True, s1[1:] > s2[:-1] + 1] if len(s1) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s1)] - 1 if len(s1) else first
    return s1[first], s2[last]


def pieces_of(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """core, hull, anchor place, first and last start, count of each piece; and the starts
    (s1, s2) of pieces that stand in this text more than once, of which one is reported."""
    parts = []
    for at in range(0, max(0, len(data) - width + 1), SEGMENT):
        part = data[at : at + SEGMENT + width - 1]
        one, two = _one.prefix(part), _two.prefix(part)
        anchor = _anchors(one, len(part), width, gram)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        place = anchor[first]
        core = _one.of(one, place, place + gram)
        hull = _mixed(_two.of(two, first, last + width) + _mixed(_U(1) + ((place - first) << 32 | (last - first)).astype(_U)))
        parts.append((core, hull, place + at, first + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(_U), none.astype(_U), none, none, none, none, none, none
    core, hull, place, s1, s2 = (np.concatenate(x) for x in zip(*parts, strict=True))
    return _collapsed(core, hull, place, s1, s2)


def pieces_of_many(one: np.ndarray, two: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """:func:`pieces_of` for texts that stand one behind another, by their prefix hashes.

    Places count in all of them; the first of the arrays says which text a piece is of, and
    marks are told apart by their place, as windows of two texts never touch.
    """
    sizes = np.diff(offsets)
    room = np.maximum(sizes - width + 1, 0)
    total = int(room.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none.astype(_U), none, none, none, none, none, none
    text = np.repeat(np.arange(len(room)), room)
    start = np.arange(total) - np.repeat(np.cumsum(room) - room, room) + offsets[text]
    anchor = _anchors(one, int(offsets[-1]), width, gram)[start]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], total] - 1
    place, s1, s2, text = anchor[first], start[first], start[last], text[first]
    core = _one.of(one, place, place + gram)
    hull = _mixed(_two.of(two, s1, s2 + width) + _mixed(_U(1) + ((place - s1) << 32 | (s2 - s1)).astype(_U)))
    core, hull, place, s1, s2, n, m1, m2 = _collapsed(core, hull, place, s1, s2, text)
    return np.searchsorted(offsets, s1, side="right") - 1, core, hull, place, s1, s2, n, m1, m2


def _collapsed(core, hull, place, s1, s2, text=None) -> tuple[np.ndarray, ...]:
    order = np.lexsort((s1, hull, core) if text is None else (s1, hull, core, text))
    c, h = core[order], hull[order]
    new = np.r_[True, (c[1:] != c[:-1]) | (h[1:] != h[:-1])] if len(c) else np.zeros(0, bool)
    if text is not None:
        new[1:] |= np.diff(text[order]) != 0
    heads = np.flatnonzero(new)
    n = np.diff(np.r_[heads, len(c)])
    again = np.zeros(len(c), bool)
    again[order] = np.repeat(n, n) > 1
    kept = order[heads]
    m1, m2 = _runs(s1[again], s2[again])
    return core[kept], hull[kept], place[kept], s1[kept], s2[kept], n, m1, m2


def cut(data: np.ndarray, place: np.ndarray, s1: np.ndarray, s2: np.ndarray, block: int, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """core, hull, anchor place, first and last start of the parts of open pieces.

    Offsets (anchor place - start) are cut at multiples of ``block``. The core of a part
    is what all windows of its whole block share, whichever of them the piece has.
    """
    low, high = (place - s2) // block, (place - s1) // block
    n = high - low + 1
    k = np.repeat(np.arange(len(place)), n)
    number = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + low[k]
    place, f1, f2 = place[k], np.maximum(s1[k], place[k] - number * block - block + 1), np.minimum(s2[k], place[k] - number * block)
    one, two = _one.prefix(data), _two.prefix(data)
    c1, c2 = place - number * block, place - number * block - block + 1 + width
    core = _mixed(_one.of(one, c1, c2) + _mixed(number.astype(_U)))
    hull = _mixed(_two.of(two, f1, f2 + width) + _mixed(_U(1) + ((place - f1) << 32 | (f2 - f1)).astype(_U)))
    return core, hull, place, f1, f2


def _structs(columns: dict[str, np.ndarray], sizes: list[int]) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    arrays = [pa.array(x.view(np.int64) if x.dtype == _U else x.astype(np.int64)) for x in columns.values()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, list(columns)))


PIECE = "core long, hull long, place long, s1 long, s2 long, n long"
MARK = "kind long, s1 long, s2 long"


def _array_of(fields: str) -> str:
    return f"array<struct<{fields.replace(' long', ':long')}>>"


def _told_apart(found: list[tuple[np.ndarray, ...]]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Pieces and marks of one text from those of each kind."""
    names = ["core", "hull", "place", "s1", "s2", "n"]
    pieces = {name: np.concatenate([f[i] for f in found]) for i, name in enumerate(names)}
    kinds = np.repeat(np.arange(len(found)), [len(f[0]) for f in found]).astype(_U)
    pieces["core"] = (pieces["core"] & ~_U(_KINDS - 1)) | kinds
    marks = {"kind": np.repeat(np.arange(len(found)), [len(f[6]) for f in found])}
    return pieces, marks | {"s1": np.concatenate([f[6] for f in found]), "s2": np.concatenate([f[7] for f in found])}


def _listed(parts: list[dict[str, np.ndarray]]) -> pa.ListArray:
    return _structs({name: np.concatenate([p[name] for p in parts]) for name in parts[0]}, [len(p["s1"]) for p in parts])


def _of_group(data: np.ndarray, offsets: np.ndarray, kinds: tuple[Windows, ...]) -> tuple[np.ndarray, dict, dict]:
    """Units of each text and kind, and pieces and marks of all texts of a group with the text's number as ``text``."""
    one, two = _one.prefix(data), _two.prefix(data)
    spans = word_spans(data, offsets) if any(k.words for k in kinds) else None
    sizes, pieces, marks = [], [], []
    for number, kind in enumerate(kinds):
        if kind.words:
            hashes, own = _word_hashes(one, *spans), np.searchsorted(spans[0], offsets)
            found = pieces_of_many(_one.prefix(hashes), _two.prefix(hashes), own, kind.width, kind.gram)
        else:
            own = offsets
            found = pieces_of_many(one, two, own, kind.width, kind.gram)
        text, core, hull, place, s1, s2, n, m1, m2 = found
        of = np.searchsorted(own, m1, side="right") - 1
        sizes.append(np.diff(own))
        pieces.append((text, (core & ~_U(_KINDS - 1)) | _U(number), hull, place - own[text], s1 - own[text], s2 - own[text], n))
        marks.append((of, np.full(len(of), number), m1 - own[of], m2 - own[of]))
    joined = lambda parts, names: dict(zip(names, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
    return np.stack(sizes, 1), joined(pieces, ("text", "core", "hull", "place", "s1", "s2", "n")), joined(marks, ("text", "kind", "s1", "s2"))


def _by_text(parts: list[dict[str, np.ndarray]], texts: int) -> pa.ListArray:
    """A list for each of so many texts, of rows that name theirs."""
    rows = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
    text = rows.pop("text")
    order = np.argsort(text, kind="stable")
    return _structs({name: x[order] for name, x in rows.items()}, np.bincount(text, minlength=texts).tolist())


def _scan(kinds: tuple[Windows, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, offsets = raw_text(batch.column("text"))
                sizes, pieces, marks = [], [], []
                for start, end in slices(offsets, GROUP):
                    part, own = data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
                    if len(part) > SEGMENT:  # a very long text, by itself
                        each = [units(part, kind.words) for kind in kinds]
                        found = _told_apart([pieces_of(x, kind.width, kind.gram) for x, kind in zip(each, kinds, strict=True)])
                        group = np.array([[len(x) for x in each]]), *({"text": np.zeros(len(f["s1"]), np.int64), **f} for f in found)
                    else:
                        group = _of_group(part, own, kinds)
                    sizes.append(group[0])
                    pieces.append({**group[1], "text": group[1]["text"] + start})
                    marks.append({**group[2], "text": group[2]["text"] + start})
                n = batch.num_rows
                texts = [data[a:b] for a, b in pairwise(offsets.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column("doc_id"),
                        pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
                        pa.array(np.diff(offsets)),
                        pa.array(np.concatenate(sizes).tolist(), pa.list_(pa.int64())),
                        _by_text(pieces, n),
                        _by_text(marks, n),
                    ],
                    ["row_id", "doc_id", "digest", "n_bytes", "n_units", "pieces", "marks"],
                )
                row += n

    return run


def _recut(block: int, kinds: tuple[Windows, ...]):
    """Rows (row_id, text, pieces) to (row_id, pieces, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                pieces, marks = [], []
                for text, opened in zip(batch.column("text"), batch.column("pieces"), strict=True):
                    number, place, s1, s2 = (np.asarray(opened.values.field(x)) for x in ("kind", "place", "s1", "s2"))
                    found = []
                    for i, kind in enumerate(kinds):
                        own = number == i
                        data = units(text.as_buffer(), kind.words) if own.any() else np.zeros(0, np.uint8)
                        found.append(_collapsed(*cut(data, place[own], s1[own], s2[own], block, kind.width)))
                    told = _told_apart(found)
                    pieces.append(told[0])
                    marks.append(told[1])
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), _listed(pieces), _listed(marks)], ["row_id", "pieces", "marks"])

    return run


def _hulls(rows: DataFrame) -> DataFrame:
    """(core, hull, n)."""
    return rows.select(F.inline("pieces")).groupBy("core", "hull").agg(F.sum("n").alias("n"))


def _judged(rows: DataFrame) -> DataFrame:
    """(core, hull, again, alive) of cores that occur twice; where pieces are is not carried along.

    ``again``: the hull occurs twice, its windows are repeated. ``alive``: another pass
    must look at one such piece, as the core also has a hull that occurs once.
    """
    hulls = _hulls(rows)
    cores = hulls.groupBy("core").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1")
    return hulls.join(cores, "core").select("core", "hull", (F.col("n") > 1).alias("again"), (F.col("least") == 1).alias("alive"))


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.select("row_id", F.inline("pieces")).select("row_id", "core", "hull", "place", "s1", "s2")


def _marks(again: DataFrame, rows: DataFrame, single: DataFrame, tag: str) -> DataFrame:
    """(row_id, kind, s1, s2): starts of windows that are repeated, but for rows that are not ``single``."""
    marks = again.select("row_id", _kind().alias("kind"), "s1", "s2").unionByName(rows.select("row_id", F.inline("marks")))
    return written(marks.join(single, "row_id", "left_semi"), f"{tag}-marks")


def _passed(rows: DataFrame, single: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """What a pass over pieces finds: marks, and (row_id, kind, place, s1, s2) of the pieces that are still open."""
    judged = written(_judged(rows), f"{tag}-judged")
    found = written(_pieces(rows).join(judged, ["core", "hull"]), f"{tag}-found")
    discard(judged)
    marks = _marks(found.filter("again"), rows, single, tag)
    opened = ["row_id", _kind().alias("kind"), "place", "s1", "s2"]
    example = [F.first(c).alias(c) for c in ("row_id", "place", "s1", "s2")]  # primitives of one and the same row
    twice = found.filter("alive AND again").groupBy("core", "hull").agg(*example).select(*opened)
    alive = written(found.filter("alive AND NOT again").select(*opened).unionByName(twice), f"{tag}-open")
    discard(found)
    return marks, alive


def _passed_last(rows: DataFrame, single: DataFrame, tag: str) -> DataFrame:
    """Marks of a pass over single windows: core and hull are the same bytes, so nothing stays open."""
    twice = written(_hulls(rows).filter("n > 1").select("core", "hull"), f"{tag}-judged")
    marks = _marks(_pieces(rows).join(twice, ["core", "hull"], "left_semi"), rows, single, tag)
    discard(twice)
    return marks


def _kind() -> Column:
    return F.col("core").bitwiseAND(F.lit(_KINDS - 1))


def _removals(kinds: tuple[Windows, ...], keep: bool):
    """Rows (row_id, text, marks) to spans and what is left.

    With ``keep``, the windows of all kinds go, else those of the first kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_id, text, marks in zip(*(batch.column(c) for c in ("row_id", "text", "marks")), strict=True):
                data = text.as_buffer().to_pybytes()
                number, s1, s2 = (np.asarray(marks.values.field(x)) for x in ("kind", "s1", "s2"))
                covered, spans = [], []
                for i, kind in enumerate(kinds):
                    own = number == i
                    first, last = _runs(s1[own], s2[own] + kind.width - 1)
                    covered.append(int((last - first + 1).sum()))
                    if kind.words and len(first):
                        starts, ends = word_spans(np.frombuffer(data, np.uint8))
                        first, last = starts[first], ends[last] - 1
                    if keep or not i:
                        spans.append((first, last))
                first, last = spans[0] if len(spans) == 1 else _runs(*(np.concatenate(x) for x in zip(*spans, strict=True)))
                left, at = [], 0
                for a, b in zip(first.tolist(), last.tolist(), strict=True):
                    left.append(data[at:a])
                    at = b + 1
                rest = b"".join([*left, data[at:]])
                row = (row_id.as_py(), len(data) - len(rest), len(first), hashlib.sha256(rest).hexdigest(), covered)
                if keep:
                    went = [{"start": a, "stop": b + 1} for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    row += (went, rest.decode("utf-8", "ignore"))
                out.append(row)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            types += [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
            names = ["row_id", "n_removed", "n_spans", "kept_sha256", "covered", "spans", "kept_text"][: 7 if keep else 5]
            columns = [pa.array([r[i] for r in out], types[i]) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def removals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep: bool = False, words: bool = False, more: tuple[Windows, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, n_bytes, n_removed, n_spans, kept_sha256, covered.

    ``keep`` adds spans (bytes [start, stop) that went) and kept_text (what is left, without
    bytes of letters that a span cut in two), both null where nothing went. With ``words``,
    ``width`` and ``gram`` count words, not bytes. ``more`` are further kinds of windows: they
    are looked for as well, and with ``keep`` they go too. ``covered`` has the units (bytes or
    words) that repeated windows cover, for the first kind and each of ``more``.
    """
    kinds = (Windows(width, gram, words), *more)
    with bounded_steps(docs.sparkSession):
        fates, parts = _search(docs, kinds, keep)
        parts = written(parts, "repeats-parts")
    return _results(fates, parts, kinds, keep)


def _search(docs: DataFrame, kinds: tuple[Windows, ...], keep: bool) -> tuple[DataFrame, DataFrame]:
    """What is known of each row, and spans and rest of those of which something goes (not computed yet)."""
    if not all(0 < k.gram < k.width for k in kinds):
        raise ValueError("a gram must be shorter than the width")
    if len(kinds) > _KINDS:
        raise ValueError(f"at most {_KINDS} kinds of windows")
    piece, mark = _array_of(PIECE), _array_of(MARK)
    types = f"row_id long, doc_id long, digest binary, n_bytes long, n_units array<long>, pieces {piece}, marks {mark}"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    facts = written(texts.mapInArrow(_scan(kinds), types), "repeats-facts")
    enough = [F.col("n_units")[i] >= k.width for i, k in enumerate(kinds)]
    some = enough[0]
    for one in enough[1:]:
        some = some | one
    copied = facts.filter(some).groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = facts.join(copied, "digest", "left")
    full = F.array(*[F.when(F.col("copies").isNotNull() & one, F.col("n_units")[i]) for i, one in enumerate(enough)])
    # full: units of a text that stands in two rows, for each kind that it has a window of
    fates = written(rows.select("row_id", "doc_id", "digest", "n_bytes", full.alias("full"), F.col("copies").isNotNull().alias("whole")), "repeats-fates")

    single = fates.filter("NOT whole").select("row_id")
    marks, alive = _passed(facts.select("row_id", "pieces", "marks"), single, "repeats-pass")
    discard(facts)
    wanted = alive.select("row_id").unionByName(marks.select("row_id")).distinct()
    named = fates.join(wanted, "row_id", "left_semi").select("row_id", F.col("doc_id").alias("id"), F.col("digest").alias("d"))
    hashed = texts.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    same = (hashed["digest"] == named["d"]) & hashed["doc_id"].eqNullSafe(named["id"])
    kept = written(hashed.join(named, same).select("row_id", "text"), "repeats-texts")
    # a text whose id and text both repeat stands in kept more than once, and so do its windows in the input
    found = [marks]
    blocks = [b for b in PASSES if b < min(k.width for k in kinds)]  # else the windows of a block share nothing; 1 is less than any
    for number, block in enumerate(blocks):
        lists = alive.groupBy("row_id").agg(F.collect_list(F.struct("kind", "place", "s1", "s2")).alias("pieces"))
        cuts = kept.join(lists, "row_id").select("row_id", "text", "pieces")
        level = written(cuts.mapInArrow(_recut(block, kinds), f"row_id long, pieces {piece}, marks {mark}"), f"repeats-cuts{number}")
        discard(alive)
        if block > 1:
            more_marks, alive = _passed(level, single, f"repeats-pass{number}")
        else:
            more_marks = _passed_last(level, single, f"repeats-pass{number}")
        found.append(more_marks)
        discard(level)
    marks = found[0]
    for another in found[1:]:
        marks = marks.unionByName(another)
    lists = marks.groupBy("row_id").agg(F.collect_list(F.struct("kind", "s1", "s2")).alias("marks"))
    types = "row_id long, n_removed long, n_spans long, kept_sha256 string, covered array<long>"
    types += ", spans array<struct<start:long,stop:long>>, kept_text string" * keep
    return fates, kept.join(lists, "row_id").select("row_id", "text", "marks").mapInArrow(_removals(kinds, keep), types)


def _results(fates: DataFrame, parts: DataFrame, kinds: tuple[Windows, ...], keep: bool) -> DataFrame:
    """What each row of the input comes to: ``parts`` has those of which something went."""
    whole = F.col("full")[0].isNotNull()
    for i in range(1, len(kinds) if keep else 1):
        whole = whole | F.col("full")[i].isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    covered = [F.coalesce(F.col("full")[i], F.col("covered")[i], F.lit(0)).cast("long") for i in range(len(kinds))]
    out = [
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.array(*covered).alias("covered"),
    ]
    if keep:
        everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
        out += [F.when(whole, everything).otherwise(F.col("spans")).alias("spans"), F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")]
    return fates.join(parts, "row_id", "left").select("doc_id", "digest", "n_bytes", *out)


def drop_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, words: bool = False, more: tuple[Windows, ...] = ()) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and ``n_chars``, if there is one, set anew.

    Every copy of a passage goes, as ``removals`` has it; no other column changes, whatever
    its name. A text that stands in two rows goes whole from both.
    """
    kinds = (Windows(width, gram, words), *more)
    with bounded_steps(docs.sparkSession):
        found = _results(*_search(docs, kinds, True), kinds, True).filter("n_removed > 0")
        cuts = written(found.select(F.col("doc_id").alias("id"), F.col("digest").alias("d"), F.col("kept_text").alias("t")).dropDuplicates(["id", "d"]), "repeats-changed")
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    base = docs.alias("docs").join(cuts.alias("c"), (digest == F.col("c.d")) & F.col("docs.doc_id").eqNullSafe(F.col("c.id")), "left")
    cut_text = F.coalesce(F.col("c.t"), F.col("docs.text"))
    out = []
    for name, kind in docs.dtypes:
        if name == "text":
            out.append(cut_text.alias("text"))
        elif name == "n_chars":
            out.append(F.when(F.col("c.t").isNull(), F.col("docs.n_chars")).otherwise(F.length(cut_text)).cast(kind).alias("n_chars"))
        else:
            out.append(F.col(f"docs.`{name}`"))
    return base.select(*out)
