"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

1. Each text is tokenised where it is read; a document longer than a sequence is cut
   into full pieces and a rest. Only the pieces' lengths move on.
2. The driver packs the *histogram* of lengths, at most ``capacity`` numbers whatever
   the input: lengths fall, and a segment tree over remaining capacities finds the
   tightest open bins for each. Pieces of one length are interchangeable, so a step
   places a whole run of them in a run of bins, and the plan stays small.
3. A piece's place among those of its length (its rank in its task plus the counts of
   the tasks before) looks up its bin and offset in the broadcast plan.

The outcome is that of best-fit decreasing over all documents one by one.

Defined results: null counts as empty, which is the closing token alone; repeated rows
are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm._merges import BatchEncoder
from docsift.llm.bpe import broadcast_file, model_of
from docsift.scratch import written

CAPACITY = 4096
CLOSING = 1


@lru_cache(maxsize=1)
def encoder_of(source: bytes) -> BatchEncoder:
    return BatchEncoder(model_of(source))


def _pieces(source, capacity: int, closing: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(source.value)
        end = np.array([closing], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at in range(0, len(texts), 256):
                rows = []
                for doc_id, ids in zip(doc_ids[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        length = len(part) // 4
                        rows.append((doc_id, piece, start // 4, length, zlib.crc32(part), task, ranks[length]) + ((part,) if keep_ids else ()))
                        ranks[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])
        encoder.words.clear()  # a worker outlives its task; what it keeps would stand in the way of other stages

    return run


class SegmentTree:
    """Which remaining capacities have open bins; the least at or above a length in log time."""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.some = [False] * (2 * self.width)

    def set(self, at: int, value: bool) -> None:
        at += self.width
        self.some[at] = value
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def least(self, low: int) -> int | None:
        """The least index >= low that is set."""
        at = low + self.width
        if self.some[at]:
            return low
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, n, first bin, offset, each): piece i of the run (from 0)
    goes to bin ``first bin + i // each`` at ``offset + (i % each) * length``.
    """
    tree = SegmentTree(capacity)
    open_bins: list[deque] = [deque() for _ in range(capacity + 1)]
    steps, bins = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not open_bins[room]:
                tree.set(room, True)
            open_bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.least(length)
            if room is None:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            else:
                first, n = open_bins[room].popleft()
                if not open_bins[room]:
                    tree.set(room, False)
            # the tightest bin stays the tightest while this length still fits
            each = room // length
            full = min(n, left // each)
            rest = 0 if full == n else left - full * each
            if full:
                steps.append((length, rank, full * each, first, capacity - room, each))
                leave(room - each * length, first, full)
            if rest:
                steps.append((length, rank + full * each, rest, first + full, capacity - room, rest))
                leave(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            if used < n:
                if not open_bins[room]:
                    tree.set(room, True)
                open_bins[room].appendleft((first + used, n - used))
            left -= full * each + rest
            rank += full * each + rest
    return steps


def _placed(steps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = steps.value
        keys = table[0] << 48 | table[1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            i = rank - table[1][at]
            each = table[5][at]
            names = [x for x in batch.schema.names if x not in ("rank",)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in names]
                + [pa.array(table[3][at] + i // each), pa.array(table[4][at] + i % each * length)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``keep_ids`` adds ids,
    packed little-endian 32-bit integers.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    schema += ", ids binary" * keep_ids
    source = broadcast_file(spark, path)
    pieces = written(docs.select("doc_id", "text").mapInArrow(_pieces(source, capacity, closing, keep_ids), schema), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(per_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-bases")
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    steps = np.array(sorted(plan(counts, capacity)) or [(0, 0, 0, 0, 0, 1)], dtype=np.int64).T.copy()
    # there are as many bases as tasks have lengths, which grows with the input: they meet the pieces by a shuffle
    ranked = pieces.join(bases.select("task", "length", "base").hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = schema.replace(", task int, rank long", "") + ", sequence_id long, offset long"
    return ranked.select(*out, "rank").mapInArrow(_placed(spark.sparkContext.broadcast(steps)), kinds)
