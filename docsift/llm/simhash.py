"""SimHash fingerprints and near-duplicate groups found with BK-trees.

A fingerprint has a bit for each bit that more than half of the shingle hashes set.
Fingerprints link at ``radius`` or fewer differing bits; a group is what links reach.

Search. With 64 bits cut into ``radius + 2`` blocks, two linked fingerprints agree on
at least two blocks, so a fingerprint belongs to one shard for each pair of blocks and
meets every link of its own in some shard. A shard's BK-tree is built from its distinct
fingerprints (children keyed by the Hamming distance to the parent) and queried along
edges within the radius only. Trees go to the task that queries them by the shuffle:
all trees together grow with the input, so a broadcast of them would have no bound.
A shard of more than ``most`` fingerprints is cut into slices, and each pair of slices
is a task of its own: a tree of one slice, queried with the other.

A shard reports a spanning forest of its links rather than all of them; the forests
together connect exactly what the links connect.

Defined results: null or blank text has fingerprint zero, which links like any other; a
null doc_id never names a group unless all ids of the group are null; repeated rows
each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm.components import components
from docsift.scratch import written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a slice of a shard: what one tree holds at most, give or take the slicing hash.
MOST = 2048
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text, repeats included."""
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(line, SEED)
    sizes = list(map(len, words))
    ends = list(accumulate((s + 1 for s in sizes), initial=0))
    ones = np.zeros(64, np.int64)
    total = n - shingle + 1
    for at in range(0, total, BLOCK):
        stop = min(at + BLOCK, total)
        hashes = np.array(
            [digest(line[a : b - 1], SEED) for a, b in zip(ends[at:stop], ends[at + shingle : stop + shingle], strict=True)],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            found = np.fromiter(
                (fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in texts),
                dtype=np.uint64,
                count=len(texts),
            )
            yield pa.RecordBatch.from_arrays([ids, pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


class BKTree:
    """Metric tree over 64-bit fingerprints."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        if self.root is None:
            self.root, self.children[value] = value, {}
            return
        at = self.root
        while at != value:
            d = (at ^ value).bit_count()
            below = self.children[at]
            if d not in below:
                below[d] = value
                self.children[value] = {}
                return
            at = below[d]

    def within(self, value: int, radius: int) -> list[int]:
        if self.root is None:
            return []
        found, todo = [], [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


def forest(trees: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links within ``trees``, or between them and ``queries``, as stars around one member each."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    tree = BKTree()
    if queries is None:
        for value in trees:
            for other in tree.within(value, radius):
                parent[find(value)] = find(other)
            tree.add(value)
    else:
        for value in trees:
            tree.add(value)
        for value in queries:
            for other in tree.within(value, radius):
                parent[find(value)] = find(other)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the radius + 2 blocks of a fingerprint."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _links(radius: int):
    """Rows sorted by (shard, low, high) to the forests' edges."""
    mask = (1 << 64) - 1

    def solve(low: int, high: int, rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
        if low == high:
            return forest([fp & mask for fp, _ in rows], None, radius)
        tree = [fp & mask for fp, part in rows if part == low]
        return forest(tree, [fp & mask for fp, part in rows if part == high], radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

        for batch in batches:
            for shard, low, high, fp, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (shard, low, high) != key:
                    if len(rows) > 1:
                        out += solve(key[1], key[2], rows)
                    key, rows = (shard, low, high), []
                rows.append((fp, part))
            if len(out) > 50_000:
                yield flush()
        if len(rows) > 1:
            out += solve(key[1], key[2], rows)
        yield flush()

    return run


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints (fp: long) as all links do."""
    cut = blocks(radius)
    shards = []
    for i, ((s1, w1), (s2, w2)) in enumerate(combinations(cut, 2)):
        one = F.shiftrightunsigned("fp", s1).bitwiseAND(F.lit((1 << w1) - 1))
        two = F.shiftrightunsigned("fp", s2).bitwiseAND(F.lit((1 << w2) - 1))
        shards.append(F.shiftleft(one, w2) + two + F.lit(i << 40))
    dealt = fps.select("fp", F.explode(F.array(*shards)).alias("shard"))
    sized = dealt.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("shard"))).filter("m > 1")
    parts = F.ceil(F.col("m") / F.lit(most)).cast("int")
    placed = sized.select("shard", "fp", parts.alias("parts")).select(
        "shard", "fp", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part")
    )
    paired = placed.select(
        "shard", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select("shard", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "part")
    ordered = paired.repartition("shard", "low", "high").sortWithinPartitions("shard", "low", "high")
    return ordered.mapInArrow(_links(radius), "u long, v long").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id."""
    facts = written(docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash")
    nodes = facts.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("fp"), radius, most))
    joined = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    joined = written(joined, "simhash-roots")
    names = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = joined.join(names, "root").select("fp", "component_id")
    return facts.join(named, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The row of each group that stays (its smallest doc_id), with all columns of ``docs``, whatever their names.

    Rows that repeat the id of the one that stays are reduced to one. A group in which
    all ids are null keeps its rows.
    """
    found = groups(docs, shingle, radius).filter("doc_id IS NOT NULL")
    fate = found.groupBy("doc_id").agg(
        F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), (F.count(F.lit(1)) > 1).alias("again")
    )
    fate = written(fate.withColumnRenamed("doc_id", "id"), "simhash-fate")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(whole, F.col("doc_id").alias("own_id"))
    judged = rows.join(fate, F.col("own_id") == F.col("id"), "left").filter("stays IS NOT FALSE")
    if not fate.filter("again").limit(1).count():
        return judged.select("whole.*")  # no id repeats, so the texts need not be dealt out a second time
    again = judged.filter("again").dropDuplicates(["own_id"])
    return judged.filter("again IS NOT TRUE").unionByName(again).select("whole.*")
