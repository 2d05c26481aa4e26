"""Byte-pair encoding as a bounded-lookahead streaming transducer, and its inverse.

Encoding. A merge list fixes how far text to the right can still change a token: the
*sufficient lookahead* (:func:`lookahead`). The transducer keeps a buffer, merges it as
if it were complete, and emits each token that ends at least that far from the buffer's
end. A stretch between two token boundaries is tokenised in the same way alone as in
its text, so what remains in the buffer is simply continued. Memory is constant for a
word of any length.

Decoding. Token bytes go through a state machine that holds back an incomplete UTF-8
sequence until its last byte has come.

A tokenizer file fixes vocabulary, merges and added tokens; this module runs files whose
normaliser is NFC, white space to a space, lower case, and whose pre-tokenizer splits by
one pattern and maps bytes to letters. Other files are refused.

Defined results: null counts as empty, which has no tokens and decodes to empty text;
repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Words with their ids kept by a worker; all go when there are so many.
MEMO = 250_000
#: Longest word kept.
MEMO_CHARS = 48
#: Tokens decoded at once.
DECODE_BLOCK = 1 << 14
NEVER = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def lookahead(merges: list[tuple[int, int, int]], sizes: list[int]) -> int:
    """Bytes at the end of a text whose tokens may still change when text follows.

    Compare merging a text alone with merging it before any continuation. Both agree up
    to a boundary d, the text's end at first. Merge r = (u, v) moves d left by |u| when
    the token before d is u and only one of the two has v behind d. That v begins with
    what an earlier step r' left behind d, so the left operand of r' is on the left
    spine of v. The longest such chain of rising ranks bounds how far d moves.
    """
    left = {new: u for u, _, new in merges}
    reach: dict[int, int] = {}
    most = 0
    for u, v, _ in merges:
        behind, at = 0, v
        while at is not None:
            behind = max(behind, reach.get(at, 0))
            at = left.get(at)
        moved = sizes[u] + behind
        reach[u] = max(reach.get(u, 0), moved)
        most = max(most, moved)
    return most


class Model:
    """A tokenizer file, ready to encode and decode."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splitters = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in splitters] != ["Split", "ByteLevel"]:
            raise ValueError("this tokenizer file's normaliser or pre-tokenizer is not supported")
        if model.get("dropout") or model.get("unk_token") or spec["post_processor"] or spec["decoder"]:
            raise ValueError("this tokenizer file's model is not supported")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pattern = regex.compile(splitters[0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + end] for x in letters]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.table: dict[int, int] = {}
        for rank, (a, b, new) in enumerate(merges):
            self.table.setdefault(a << 32 | b, rank << 32 | new)
        names = sorted(((i, name) for name, i in {**vocab, **self.added}.items()))
        self.tokens = dict(names)
        # without a decoder, the text of ids is their names with a space between
        self.joined = {i: name.encode() for i, name in names}
        back = {x: b for b, x in enumerate(letters)}
        self.spelled = {}
        for i, name in names:
            if name in self.added:
                self.spelled[i] = name.encode()
            else:
                word = name.removesuffix(end)
                self.spelled[i] = bytes(back[x] for x in word) + b" " * (word != name)
        sizes = [0] * (max(self.tokens) + 1)
        for i, name in names:
            sizes[i] = len(name.removesuffix(end))
        self.lookahead = lookahead(merges, sizes)
        self.sizes = sizes
        self.memo: dict[str, bytes] = {}
        self.pieces: dict[str, list[int]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """Apply merges by rank, leftmost first, until none applies."""
        get = self.table.get
        pairs = [get(a << 32 | b, NEVER) for a, b in pairwise(ids)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            i = pairs.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | ids[i], NEVER)
            if i < len(pairs):
                pairs[i] = get(ids[i] << 32 | ids[i + 1], NEVER)
        return ids

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one word of any length, through the transducer."""
        feed = Transducer(self)
        block = self.lookahead + 256
        if len(piece) <= block:
            return feed.finish(piece)
        out: list[int] = []
        for at in range(0, len(piece), block):
            part = piece[at : at + block]
            out += feed.finish(part) if at + block >= len(piece) else feed.feed(part)
        return out

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no special form at a word's end

    def chunk_ids(self, chunk: str) -> bytes:
        """Packed ids of text that is encoded on its own, such as what stands between two spaces."""
        out: list[int] = []
        known = self.pieces
        split = any(x in chunk for x in self.added)
        for k, part in enumerate(self.added_pattern.split(chunk) if split else [chunk]):
            if k % 2:
                out.append(self.added[part])
                continue
            for piece in self.pattern.findall(self.normalise(part)):
                ids = known.get(piece)
                if ids is None:
                    ids = self.piece_ids(piece.encode())
                    if len(piece) <= MEMO_CHARS:
                        known[piece] = ids
                out += ids
        return array("I", out).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers."""
        memo = self.memo
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join([memo[x] for x in parts])
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        own: dict[str, bytes] = {}
        for x in parts:
            if x not in memo:
                (memo if len(x) <= MEMO_CHARS else own)[x] = self.chunk_ids(x)
        return b"".join([memo[x] if x in memo else own[x] for x in parts])


class Transducer:
    """Feeds on the bytes of one word; gives ids as soon as they are stable."""

    def __init__(self, model: Model) -> None:
        self.model, self.buffer = model, b""

    def feed(self, part: bytes) -> list[int]:
        self.buffer += part
        model = self.model
        room = len(self.buffer) - model.lookahead
        if room <= 0:
            return []
        inner, sizes = model.inner, model.sizes
        out, at = [], 0
        for token in model.merged([inner[b] for b in self.buffer]):
            if at + sizes[token] > room:
                break
            at += sizes[token]
            out.append(token)
        self.buffer = self.buffer[at:]
        return out

    def finish(self, part: bytes = b"") -> list[int]:
        data, self.buffer = self.buffer + part, b""
        if not data:
            return []
        inner = self.model.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.model.final[data[-1]]
        return self.model.merged(ids)


class TextStream:
    """Bytes in, text out: an incomplete UTF-8 sequence waits for its other bytes."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        stop = len(data)
        for back in range(1, min(4, stop) + 1):
            lead = data[stop - back]
            if lead < 0x80:
                break
            if lead >= 0xC0:
                need = 2 + (lead >= 0xE0) + (lead >= 0xF0)
                if need > back:
                    stop -= back
                break
        self.pending = data[stop:]
        return data[:stop].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


def decode(model: Model, ids: np.ndarray, spelled: bool = False) -> Iterator[str]:
    """Text of ids, piece by piece.

    By default as a tokenizer without a decoder writes it: token names with a space
    between. ``spelled`` maps letters back to bytes and a word's end to a space.
    """
    stream, table = TextStream(), model.spelled if spelled else model.joined
    gap = b"" if spelled else b" "
    for at in range(0, len(ids), DECODE_BLOCK):
        block = gap.join([table[i] for i in ids[at : at + DECODE_BLOCK].tolist()])
        yield stream.feed(gap + block if at else block)
    yield stream.finish()


@lru_cache(maxsize=2)
def model_of(source: bytes) -> Model:
    """One model for each tokenizer file and worker."""
    return Model(source)


def tokenizer_bytes(path: str) -> bytes:
    """The file is read where the plan is made and sent along, as it is small and of fixed size."""
    with open(path, "rb") as file:
        return file.read()


def _texts(column: pa.Array) -> Iterable[str]:
    return ((x.as_py() or "") for x in column)


def _digests(source, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(source.value)
        for batch in batches:
            counts, id_hashes, text_hashes, packed, decoded = [], [], [], [], []
            for text in _texts(batch.column("text")):
                ids = model.encode(text)
                counts.append(len(ids) // 4)
                id_hashes.append(hashlib.sha256(ids).hexdigest())
                said = hashlib.sha256()
                pieces = []
                for piece in decode(model, np.frombuffer(ids, "<u4")):
                    said.update(piece.encode())
                    if keep:
                        pieces.append(piece)
                text_hashes.append(said.hexdigest())
                if keep:
                    packed.append(np.frombuffer(ids, "<u4").astype(np.int64).tolist())
                    decoded.append("".join(pieces))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array(packed, pa.list_(pa.int64())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def broadcast_file(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(tokenizer_bytes(path))


def round_trip(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Encode each text, decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``keep`` adds ids (array of long) and decoded (string).
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep:
        schema += ", ids array<long>, decoded string"
    source = broadcast_file(docs.sparkSession, path)
    return docs.select("doc_id", "text").mapInArrow(_digests(source, keep), schema)
