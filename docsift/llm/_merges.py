"""Byte-pair merges of many short words at once."""

from __future__ import annotations

import re

import numpy as np

from docsift.llm.bpe import MEMO_CHARS, NEVER, Model

#: Words longer than this are left to the transducer.
LONGEST = 48


class BatchMerger:
    """Applies a model's merges to words of one length as the rows of a matrix.

    Each round does the best merge of every row that has one, so all rows that go on
    lose one symbol; equal ranks in a row are the same merge, of which the first counts.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        table = sorted(model.table.items())
        self.keys = np.array([k for k, _ in table], np.int64)
        self.codes = np.array([v for _, v in table], np.int64)
        self.inner, self.final = np.array(model.inner, np.int64), np.array(model.final, np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.codes[at], NEVER)

    def _same_length(self, data: np.ndarray) -> list[bytes]:
        ids = self.inner[data]
        ids[:, -1] = self.final[data[:, -1]]
        out: list[bytes] = [b""] * len(ids)
        rows = np.arange(len(ids))
        pairs = self._lookup(ids[:, :-1], ids[:, 1:])
        while True:
            best = pairs.min(axis=1) if pairs.shape[1] else np.full(len(ids), NEVER)
            done = best == NEVER
            if done.any():
                packed, width = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = packed[k * width : (k + 1) * width]
                going = ~done
                ids, pairs, rows, best = ids[going], pairs[going], rows[going], best[going]
                if not len(rows):
                    return out
            at, each = pairs.argmin(axis=1), np.arange(len(rows))
            ids[each, at] = best & 0xFFFFFFFF
            stay = np.ones(ids.shape, bool)
            stay[each, at + 1] = False
            ids = ids[stay].reshape(len(rows), -1)
            stay = np.ones(pairs.shape, bool)
            stay[each, at] = False
            pairs = pairs[stay].reshape(len(rows), -1)
            left = np.flatnonzero(at > 0)
            pairs[left, at[left] - 1] = self._lookup(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < pairs.shape[1])
            pairs[right, at[right]] = self._lookup(ids[right, at[right]], ids[right, at[right] + 1])

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word."""
        found: dict[str, bytes] = {}
        lengths: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode()
            lengths.setdefault(len(data), []).append((word, data))
        for n, group in lengths.items():
            if n > LONGEST:
                for word, data in group:
                    found[word] = np.array(self.model.piece_ids(data), "<u4").tobytes()
                continue
            matrix = np.frombuffer(b"".join([data for _, data in group]), np.uint8).reshape(-1, n)
            for at in range(0, len(group), 1 << 16):
                for (word, _), ids in zip(group[at : at + (1 << 16)], self._same_length(matrix[at : at + (1 << 16)]), strict=False):
                    found[word] = ids
        return found


#: A splitting pattern, and what it comes to for lower-case ASCII text, where it needs no Unicode classes.
UNICODE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_SPLIT = re.compile(r"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t\n\r\f\va-z0-9]+")


class BatchEncoder:
    """Ids of texts, a batch at a time; each word is encoded once and kept for a while."""

    #: Words with their ids kept by a worker.
    MEMO = 500_000

    def __init__(self, model: Model) -> None:
        self.model, self.merger = model, BatchMerger(model)
        self.words: dict[str, bytes] = {}
        self.plain_ascii = model.pattern.pattern == UNICODE_SPLIT

    def _split(self, text: str) -> list[str]:
        pattern = ASCII_SPLIT if self.plain_ascii and text.isascii() else self.model.pattern
        return pattern.findall(self.model.normalise(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        model, known = self.model, self.words
        if len(known) > self.MEMO:
            known.clear()
        plain = [not any(mark in x for mark in model.added) for x in texts]
        cut = [self._split(x) if ok else [] for x, ok in zip(texts, plain, strict=True)]
        new = set().union(*cut).difference(known)
        own: dict[str, bytes] = {}
        if new:
            short = [x for x in new if len(x) <= MEMO_CHARS]
            known |= self.merger.encode(short)
            if len(short) < len(new):
                own = self.merger.encode([x for x in new if len(x) > MEMO_CHARS])
        get = known.__getitem__
        if own:
            get = lambda w: known[w] if w in known else own[w]
        return [b"".join(map(get, words)) if ok else model.encode(x) for x, words, ok in zip(texts, cut, plain, strict=True)]
