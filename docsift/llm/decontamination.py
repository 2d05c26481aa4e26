"""Benchmark passages in documents: a prefix-filtered set join in DataFrame expressions alone.

An item is cut into windows of ``width`` consecutive words, and a window is the set of its
shingles, each at its place. A document that holds the window holds all of them, so the
rarest one is a prefix that suffices: only places where a document has some window's rarest
shingle are candidates. Of these stay the ones where the window fits between the document's
ends (positional and length bound), and the words there must be the window's (exact check).
A window with a shingle that no document has is never looked for.

Rarity counts every shingle of every document. The prefixes are broadcast, in blocks of at
most about ``block`` numbers of 64 bits, so that no row of a document's words is shuffled:
what goes on from a candidate is the few words around it.

Null and empty texts have no words. Rows are told apart by id and text (rows equal in both
have equal results); null ids are an id. Items with a null id hit words, but are not listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.scratch import written

#: Words of a window and of a shingle; prefixes that are broadcast at once (16 MB as a hash table).
WIDTH, SHINGLE, BLOCK = 10, 3, 1 << 20
#: What separates words, once A-Z are in lower case.
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: runs of digits, letters and all that is not ASCII, with A-Z in lower case."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, SEPARATOR), "")


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, window): each window of an item (item_id, text) once, its words joined by blanks."""
    own = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return own.select("item_id", F.explode(F.transform(starts, lambda k: F.array_join(F.slice("words", k, width), " "))).alias("window")).distinct()


def _places(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds (place, token): each place of ``words``, and the shingles that start there, of the given lengths."""
    each = texts.select("*", F.posexplode("words").alias("place", "word"))

    def token(n: int) -> Column:
        hashed = F.xxhash64(F.lit(n), "word", *[F.get("words", F.col("place") + i) for i in range(1, n)])
        return F.when(F.col("place") + n <= F.size("words"), hashed)

    if len(lengths) == 1:
        return each.withColumn("token", token(lengths[0])).filter("token IS NOT NULL")
    return each.select("*", F.explode(F.array(*map(token, lengths))).alias("token")).filter("token IS NOT NULL")


def _prefixed(docs: DataFrame, listed: DataFrame, shingle: int) -> tuple[DataFrame, list[int]]:
    """(window, length, token, place) of each window that may occur: its rarest shingle; and the shingles' lengths."""
    sets = listed.select("window").distinct().withColumn("words", F.split("window", " ")).withColumn("length", F.size("words"))
    sets = written(sets, "leak-windows")
    lengths = sorted(r[0] for r in sets.select(F.least("length", F.lit(shingle))).distinct().collect())  # at most ``shingle`` numbers
    if not lengths:
        return sets.select("window", "length", F.lit(0).cast("long").alias("token"), F.lit(0).alias("place")).filter("false"), []
    own = [_places(sets.filter(F.least("length", F.lit(shingle)) == n), [n]) for n in lengths]
    parts = written(reduce(DataFrame.unionByName, own).select("window", "length", "place", "token"), "leak-shingles")
    wanted = written(parts.select("token").distinct(), "leak-tokens")
    counts = _places(docs, lengths).select("token").join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "token", "place"))
    full = F.count("n") == F.col("length") - F.least("length", F.lit(shingle)) + 1
    met = parts.join(counts, "token", "left").groupBy("window", "length").agg(rarest.alias("r"), full.alias("full"))
    return written(met.filter("full").select("window", "length", "r.token", "r.place"), "leak-prefixes"), lengths


def _met(docs: DataFrame, prefixes: DataFrame, lengths: list[int], tokens: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, start, length, window) of occurrences whose prefix is in the broadcast ``tokens``."""
    first = F.greatest(F.col("place") - (width - 1), F.lit(0))
    near = _places(docs, lengths).join(F.broadcast(tokens), "token")
    near = near.select("doc_id", "digest", "token", "place", F.size("words").alias("n"), first.alias("first"), F.slice("words", first + 1, F.lit(2 * width - 1)).alias("near"))
    rows = near.join(prefixes.withColumnRenamed("place", "within"), "token").withColumn("start", F.col("place") - F.col("within"))
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n"))
    there = F.array_join(F.slice("near", F.greatest(F.col("start") - F.col("first"), F.lit(0)) + 1, F.col("length")), " ")
    return rows.filter(fits & (there == F.col("window"))).select("doc_id", "digest", "start", "length", "window")


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Where windows of items (item_id, text) stand in documents (doc_id, text).

    Two tables: (doc_id, digest, start, length, window), with words counted from 0 and
    ``digest`` a hash of the text, and (item_id, window). Together they say which item has
    which words of a document; an item window that a great many documents hold is not
    multiplied by the items that share it.
    """
    listed = written(windows(items, width), "leak-items")
    texts = _digested(docs)
    prefixes, lengths = _prefixed(texts, listed, min(shingle, width))
    tokens = prefixes.select("token").distinct()
    blocks = -(-tokens.count() // block)
    if not blocks:
        empty = texts.select("doc_id", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")).filter("false")
        return empty, listed
    own = [tokens if blocks == 1 else tokens.filter(F.pmod("token", F.lit(blocks)) == i) for i in range(blocks)]
    found = [_met(texts, prefixes, lengths, t, width) for t in own]
    return written(reduce(DataFrame.unionByName, found).distinct(), "leak-places"), listed


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts words inside any occurrence of a window; the digest is of the ids of the
    items that occur, sorted as strings and joined by commas.
    """
    places, listed = occurrences(docs, items, width, shingle, block)
    row = ["doc_id", "digest"]
    hit = places.select(*row, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("at")).distinct()
    hits = hit.groupBy(*row).agg(F.count(F.lit(1)).alias("n_hit"))
    pairs = places.select(*row, "window").distinct().join(listed.filter("item_id IS NOT NULL"), "window").select(*row, F.col("item_id").cast("string").alias("item")).distinct()
    named = F.array_sort(F.collect_list("item"))
    by_row = pairs.groupBy(*row).agg(F.count(F.lit(1)).alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items"))
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & F.col("d.digest").eqNullSafe(F.col(f"{other}.digest"))
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = all_docs.alias("d").join(hits.alias("h"), same("h"), "left").join(by_row.alias("i"), same("i"), "left")
    return joined.select(
        "d.doc_id",
        "d.n_words",
        F.coalesce("h.n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("i.n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("i.items", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        (F.coalesce("h.n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
