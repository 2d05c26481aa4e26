"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, and the least
hash in any case, so that no text with words has an empty sketch. Sketches of any two
texts are comparable however unequal their lengths: the share of one sketch's hashes
that the other has estimates containment, and the sketch of a union is the union.
Texts are cut into words at ASCII white space after lower-casing A-Z; a text with fewer
words than a shingle has itself as its only shingle.

:func:`with_next` compares each document with its edited text (the last half of its code
points replaced by the first as many of the next document) and with the next document,
by descending id. Documents are range-partitioned at ids that occur in the table; the
row at a bound is also sent to the range before it, and the first row of all behind the
last, so each task finds every neighbour among its own rows and nothing is ordered as a
whole.

Defined results: null counts as empty; a text without words has an empty sketch, alike
(1) to another and unlike (0) any other; rows that repeat an id are ordered by a hash of
their text; a null id has no place in the order, and the text next to it is empty; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._columns import raw_text
from docsift.llm.repeats import Rolling, _mixed

SHINGLE = 5
#: Share of the hash range that is kept.
SHARE = 0.25
#: Text handled together, in characters.
STEP = 1 << 19
#: Bytes of a kept hash: its high bytes, in order.
WIDTH = 6
_words = Rolling(41)
_U = np.uint64


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower()
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and how many words the texts before each text have."""
    blank = BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1]] = True
    inside = ~blank
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:] | edge[1:-1]
    ends = np.flatnonzero(inside & after) + 1
    prefix = _words.prefix(LOWER[data])
    return _mixed(_words.of(prefix, starts, ends)), np.searchsorted(starts, offsets)


def sketches(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, share: float = SHARE) -> list[np.ndarray]:
    """Ascending distinct kept hashes of each text, ``WIDTH`` high bytes of each."""
    words, first = word_hashes(data, offsets)
    n = np.diff(first)
    texts = len(n)
    count = np.where(n > 0, np.maximum(n - shingle + 1, 1), 0)
    text = np.repeat(np.arange(texts), count)
    at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + first[text]
    value = np.zeros(len(text), _U)
    stop = first[text + 1]
    for k in range(shingle):
        there = at + k < stop
        value[there] = value[there] * _U(0xFF51AFD7ED558CCD) + _mixed(words[(at + k)[there]] + _U(k + 1))
    value = _mixed(value) >> _U(64 - 8 * WIDTH)
    least = np.full(texts, ~_U(0))
    np.minimum.at(least, text, value)
    kept = (value < _U(int(share * (1 << 8 * WIDTH)))) | (value == least[text])
    text, value = text[kept], value[kept]
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    text, value = text[new], value[new]
    return np.split(value, np.searchsorted(text, np.arange(1, texts)))


def to_text(sketch: np.ndarray) -> str:
    packed = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :]
    return base64.b64encode(packed.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    packed = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, 8 - WIDTH :] = packed
    return out.view(">u8").ravel().astype(_U)


def merged(one: np.ndarray, two: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Sketch of a text that has the shingles of both."""
    both = np.union1d(one, two)
    return both[(both < _U(int(share * (1 << 8 * WIDTH)))) | (np.arange(len(both)) == 0)]


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingles."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    a, b = set(one.tolist()), set(two.tolist())
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def containment(one: np.ndarray, two: np.ndarray) -> float:
    """Estimated share of the shingles of ``one`` that ``two`` has."""
    if not len(one):
        return 1.0
    return len(set(one.tolist()) & set(two.tolist())) / len(one)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _of(texts: list[str]) -> list[np.ndarray]:
    return sketches(*raw_text(pa.array(texts, pa.string())))


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(ids: list, texts: list[str], following: list[str] | None) -> pa.RecordBatch:
    """Rows for ``ids``; the text next to i is ``following[i]``, or texts[i + 1] if None."""
    n = len(ids)
    changed = [edited(t, f) for t, f in zip(texts, following or texts[1:], strict=False)]
    found = _of([*texts, *changed])
    own, other = found[: len(texts)], found[len(texts) :]
    near = _of(following) if following else own[1:]
    columns = [
        ids,
        [len(t) for t in texts[:n]],
        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        [to_text(s) for s in own[:n]],
        [to_text(s) for s in other],
        [likeness(a, b) for a, b in zip(own, other, strict=False)],
        [likeness(a, b) for a, b in zip(own, near, strict=False)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], OUT)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, extra, doc_id, text) in order; the first extra row ends its bucket."""
    bucket, ended = None, False
    ids: list = []
    texts: list[str] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        """All rows but the last, whose neighbour is still to come."""
        nonlocal ids, texts, size
        if len(texts) > 1:
            yield _compared(ids[: len(texts) - 1], texts, None)
        ids, texts, size = ids[-1:], texts[-1:], 0

    for batch in batches:
        for b, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket:
                yield from flush()
                bucket, ended, ids, texts = b, False, [], []
            if ended:
                continue
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if extra:
                yield from flush()
                ended, ids, texts = True, [], []
            elif size >= STEP:
                yield from flush()
    yield from flush()


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()]
        for at in range(0, len(ids), 200):
            part = texts[at : at + 200]
            yield _compared(ids[at : at + 200], part, [""] * len(part))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs`` in the columns of ``SCHEMA``."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * tasks
    plain = docs.select("doc_id", "text")
    placed = plain.filter("doc_id IS NOT NULL")
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds, top = placed.agg(F.percentile_approx("doc_id", shares, 20 * ranges), F.max("doc_id")).first()
    bounds = sorted({*(bounds or [])} - {top})  # as many ids as ranges at most, each of which occurs
    lonely = plain.filter("doc_id IS NULL").mapInArrow(_alone, SCHEMA)
    if top is None:
        return lonely
    edges = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.lit([]).cast("array<long>")
    below = F.size(F.filter(edges, lambda e: e < F.col("doc_id"))).cast("int")
    own = F.struct(below.alias("bucket"), F.lit(0).alias("extra"))
    bound = F.when(F.array_contains(edges, F.col("doc_id")), F.struct((below + 1).alias("bucket"), F.lit(1).alias("extra")))
    first = F.when(F.col("doc_id") == F.lit(top), F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("extra")))
    dealt = placed.select("doc_id", "text", F.explode(F.array_compact(F.array(own, bound, first))).alias("to"))
    dealt = dealt.select("to.bucket", "to.extra", "doc_id", "text", F.xxhash64("text").alias("mark"))
    order = [F.col("bucket"), (F.col("extra") == 2).asc(), F.col("doc_id").desc(), F.col("mark")]
    sorted_rows = dealt.repartition(tasks, "bucket").sortWithinPartitions(*order)
    found = sorted_rows.select("bucket", (F.col("extra") > 0).alias("extra"), "doc_id", "text").mapInArrow(_ordered, SCHEMA)
    return found.unionByName(lonely)
