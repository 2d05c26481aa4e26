"""Near copies by SimHash and BK-trees: 5-word shingle sets of Jaccard similarity 0.8 or more.

A text is a *node*, the hash of its shingle set, so texts of equal sets are one.

Shards. Sets of similarity 0.8 differ in about 0.151 of their SimHash bits, which op8's 4 of
64 can not reach, and blocks of bits that survive such a radius are too short to split an
input (16 equal bits come through in 0.07 of pairs, but also in 1 of 65536 unlike ones). So
a shard is not a block of bits but a key of ``ROWS`` minima of the set, ``BANDS`` for each
text: sets of similarity 0.8 share one with a probability of 1 - (1 - 0.8 ** 7) ** 40 =
0.9999, more alike sets more surely, unlike sets hardly ever. The nodes that shards connect
are a *heap*; a shard's nodes meet as a star around the one that meets most others.

Search. A heap's nodes go to one task, which builds a BK-tree of their SimHash fingerprints
of ``BITS`` bits and follows edges within ``RADIUS`` only. At 0.8 a pair differs in 38.7 bits
with a deviation of 5.7, so 64 leaves nothing out in practice; unlike texts differ in about
128. Every pair that the tree finds is checked by the exact similarity, unless its texts
are connected already.

Large heaps. Beyond ``most`` nodes, each node is first checked against its best centre only,
in tasks of bounded size, and nodes so connected are one *body*. Then slices of bodies and
of what is left meet pair by pair, but a body's slices never meet each other: a group of
copies that holds a third of all rows costs one check a row, plus what is not connected.

Words are split at blanks and compared in lower case (of ASCII); a text of fewer than five
words is one shingle. Blank and null texts are copies of each other. Rows are told apart by
id and text; where both repeat, one of the rows stays. A null id ranks last. Extra columns
may have any names; an empty table gives an empty result. A task holds the sets of at most
two slices, and texts and sets go to Python in batches of a few MB.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.components import components
from docsift.llm.fates import staying, text_key
from docsift.llm.simhash import BKTree
from docsift.scratch import discard, written
from docsift.session import bounded_steps

SHINGLE, LEAST, SEED = 5, 0.8, 42
ROWS, BANDS = 7, 40
BITS, RADIUS = 256, 64
#: Nodes in a slice of a heap, give or take the slicing hash.
MOST = 512
#: Shingles whose minima or bits are taken at once.
BLOCK = 1 << 11
_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2)
_TIMES = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDEN = _rng.integers(0, 1 << 63, BITS // 64, dtype=np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles of a text, in order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip(ends, ends[shingle:], strict=False)], np.uint64))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def keys_of(found: np.ndarray) -> np.ndarray:
    """A key for each band; none for a text without words, which has its copies in its node."""
    if not len(found):
        return found
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(found), BLOCK):
        np.minimum(least, ((found[at : at + BLOCK, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64)


def fingerprint(found: np.ndarray) -> int:
    """SimHash of ``BITS`` bits of a set of shingle hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), BLOCK):
        wide = found[at : at + BLOCK, None] ^ _WIDEN
        for shift, times in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            wide = (wide ^ (wide >> np.uint64(shift))) * np.uint64(times)
        wide ^= wide >> np.uint64(33)
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes())


def alike(one: np.ndarray, two: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    small, large = sorted((len(one), len(two)))
    if small < least * large - 1e-9:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both >= least * (small + large - both) - 1e-9


def _longs(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)))


def _bytes(text: pa.Scalar) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


def _facts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, texts = batch.columns
            sets = [shingles(_bytes(t), shingle) for t in texts]
            nodes = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
            columns = [ids, digests, pa.array(nodes), _longs([keys_of(x) for x in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", "keys"])

    return run


def _sets(shingle: int):
    """Texts to their shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = _longs([shingles(_bytes(t), shingle) for t in batch.column("text")])
                yield pa.RecordBatch.from_arrays([batch.column("node"), found], ["node", "members"])

    return run


def similar(nodes: list[int], sets: list[np.ndarray], bodies: list[int], sides: list[int] | None = None, least: float = LEAST, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the nodes, of which those of a body are connected already, as all
    pairs of ``least`` similarity do; with ``sides``, as the pairs of either side 0 and 1 do."""
    number = {body: i for i, body in enumerate(dict.fromkeys(bodies))}
    label, fps = np.array([number[b] for b in bodies]), [fingerprint(x) for x in sets]
    tree, holders, out = BKTree(), defaultdict(list), []

    def add(x: int) -> None:
        tree.add(fps[x])
        holders[fps[x]].append(x)

    def query(x: int) -> None:
        for fp in tree.within(fps[x], radius):
            for y in holders[fp]:
                if label[x] != label[y] and alike(sets[x], sets[y], least):
                    out.append((nodes[x], nodes[y]))
                    label[label == label[y]] = label[x]

    if sides is None:
        for x in range(len(nodes)):
            query(x)
            add(x)
    else:
        for side, step in ((0, add), (1, query)):
            for x in range(len(nodes)):
                if sides[x] == side:
                    step(x)
    return out


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...], rest: tuple[str, ...]) -> Iterator[tuple[tuple, tuple]]:
    """(key, (rest, members)) of each row; the members are a copy, so that the batch can go."""
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in key), strict=True)
        others = zip(*(batch.column(c).to_pylist() for c in rest), strict=True)
        for row, (k, other) in enumerate(zip(keys, others, strict=True)):
            yield k, (*other, np.asarray(batch.column("members")[row].values).view(np.uint64).copy())


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _stars(least: float):
    """Rows sorted by (u, salt), the centre first, to the edges that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, at, found = None, None, []
        for key, (spoke, node, members) in _runs(batches, ("u", "salt"), ("spoke", "node")):
            if not spoke:
                centre, at = members, key
            elif at == key and alike(centre, members, least):
                found.append((key[0], node))
                if len(found) > 50_000:
                    yield _edges(found)
                    found = []
        yield _edges(found)

    return run


def _links(least: float):
    """Rows sorted by (heap, low, high) to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solved() -> pa.RecordBatch:
            nodes, bodies, parts, sets = map(list, zip(*rows, strict=True))
            sides = None if key[1] == key[2] else [int(part == key[2]) for part in parts]
            return _edges(similar(nodes, sets, bodies, sides, least))

        for at, row in _runs(batches, ("heap", "low", "high"), ("node", "body", "part")):
            if at != key:
                if len(rows) > 1:
                    yield solved()
                key, rows = at, []
            rows.append(row)
        if len(rows) > 1:
            yield solved()

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", text_key().alias("digest"))


def _facts_of(docs: DataFrame, shingle: int) -> DataFrame:
    kinds = "doc_id long, digest long, node long, keys array<long>"
    return written(_keyed(docs).select("doc_id", "digest", "text").mapInArrow(_facts(shingle), kinds), "near-facts")


def _shards(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by heap, and the best centre of each node that has one: (node, heap), (u, node)."""
    stars = facts.select("node", F.explode("keys").alias("key"))
    shared = stars.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size"))
    met = written(stars.join(shared.filter("first < last").select("key", "size"), "key").distinct(), "near-shards")
    ranked = met.join(met.groupBy("node").agg(F.sum("size").alias("degree")), "node").select("key", "node", F.struct("degree", "node").alias("rank"))
    ranked = written(ranked, "near-ranked")
    centres = ranked.groupBy("key").agg(F.max("rank").alias("centre"))
    edges = written(ranked.join(centres, "key").select("node", "centre").distinct(), "near-edges")
    discard(met)
    heaps = written(components(edges.select(F.col("centre.node").alias("u"), F.col("node").alias("v"))).withColumnRenamed("root", "heap"), "near-heaps")
    best = edges.groupBy("node").agg(F.max("centre").alias("centre")).select(F.col("centre.node").alias("u"), "node").filter("u != node")
    return heaps, best


def _bodies(sets: DataFrame, large: DataFrame, best: DataFrame, least: float, most: int) -> DataFrame:
    """(node, root) of the nodes of large heaps that are connected by way of their best centres."""
    best = written(best.join(large.select("node"), "node", "left_semi"), "near-best")
    salts = best.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("salts"))
    spokes = best.join(salts, "u").select("u", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(True).alias("spoke"), "node")
    hubs = salts.select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("spoke"), F.col("u").alias("node"))
    dealt = hubs.unionByName(spokes).join(sets, "node").select("u", "salt", "spoke", "node", "members")
    ordered = dealt.repartition("u", "salt").sortWithinPartitions("u", "salt", "spoke")
    return components(ordered.mapInArrow(_stars(least), "u long, v long"))


def _sliced(large: DataFrame, bodies: DataFrame, most: int) -> DataFrame:
    """Nodes of large heaps, a row for each pair of slices that must meet."""
    nodes = large.join(bodies, "node", "left").select("heap", "node", F.coalesce("root", "node").alias("body"))
    nodes = written(nodes, "near-nodes")
    solid = nodes.groupBy("heap", "body").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most // 2).select("heap", "body", F.col("body").alias("solid"))
    nodes = nodes.join(solid, ["heap", "body"], "left")
    sizes = nodes.groupBy(F.col("heap").alias("h"), F.col("solid").alias("s")).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).cast("int").alias("slices"))
    nodes = nodes.join(sizes, (F.col("heap") == F.col("h")) & F.col("solid").eqNullSafe(F.col("s")))
    place = F.pmod(F.xxhash64("node"), "slices")
    part = F.xxhash64(F.coalesce("solid", F.lit(0)), F.col("solid").isNull(), place).alias("part")
    nodes = written(nodes.select("heap", "node", "body", "solid", part), "near-slices")
    slices = nodes.select("heap", "part", "solid").distinct()
    apart = "a.heap = b.heap AND a.part <= b.part AND (a.solid IS NULL OR b.solid IS NULL OR a.solid != b.solid)"
    pairs = slices.alias("a").join(slices.alias("b"), F.expr(apart)).select("a.heap", F.col("a.part").alias("low"), F.col("b.part").alias("high"))
    sides = pairs.select("heap", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("part"))
    return nodes.join(sides, ["heap", "part"]).select("heap", "low", "high", "part", "node", "body")


def links(docs: DataFrame, facts: DataFrame, shingle: int = SHINGLE, least: float = LEAST, most: int = MOST) -> DataFrame:
    """Edges (u, v) between nodes that connect them as all pairs of ``least`` similarity do."""
    heaps, best = _shards(facts)
    example = F.min(F.struct("doc_id", "digest")).alias("e")
    wanted = facts.join(heaps, "node", "left_semi").groupBy("node").agg(example)
    wanted = written(wanted.select("node", F.col("e.doc_id").alias("id"), F.col("e.digest").alias("d")), "near-wanted")
    texts = _keyed(docs)
    same = (texts["digest"] == wanted["d"]) & texts["doc_id"].eqNullSafe(wanted["id"])
    found = texts.join(wanted, same).select("node", "text")
    sets = written(found.mapInArrow(_sets(shingle), "node long, members array<long>").dropDuplicates(["node"]), "near-sets")
    sized = heaps.join(heaps.groupBy("heap").agg(F.count(F.lit(1)).alias("n")), "heap")
    none = F.lit(0).cast("long")
    bodies = None
    dealt = sized.filter(F.col("n") <= most).select("heap", none.alias("low"), none.alias("high"), none.alias("part"), "node", F.col("node").alias("body"))
    if sized.filter(F.col("n") > most).limit(1).count():
        large = written(sized.filter(F.col("n") > most).select("heap", "node"), "near-large")
        bodies = written(_bodies(sets, large, best, least, most), "near-bodies")
        dealt = dealt.unionByName(_sliced(large, bodies, most))
    whole = dealt.join(sets, "node").select("heap", "low", "high", "part", "node", "body", "members")
    ordered = whole.repartition("heap", "low", "high").sortWithinPartitions("heap", "low", "high")
    found = ordered.mapInArrow(_links(least), "u long, v long").distinct()
    return found if bodies is None else found.unionByName(bodies.select(F.col("node").alias("u"), F.col("root").alias("v")))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, most: int = MOST) -> DataFrame:
    """One row of each group that links connect, with all columns of ``docs``.

    It is the row with the smallest doc_id (null last); rows are told apart by id and text.
    """
    with bounded_steps(docs.sparkSession):
        facts = _facts_of(docs, shingle)
        roots = components(links(docs, facts, shingle, least, most))
        rows = facts.select("doc_id", "digest", "node").join(roots, "node", "left")
        rows = rows.groupBy("doc_id", "digest", F.coalesce("root", "node").alias("root")).agg(F.count(F.lit(1)).alias("n"))
        rows = written(rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")), "near-rows")
        best = rows.groupBy("root").agg(F.min("rank").alias("best"), F.sum("n").alias("all")).filter("all > 1")
        fate = rows.join(best, "root").select(F.col("doc_id").alias("id"), F.col("digest").alias("key"), F.col("rank").eqNullSafe(F.col("best")).alias("stays"), "n")
        return staying(docs, fate, "near-fate")
