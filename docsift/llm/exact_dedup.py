"""Exact deduplication with a heavy-hitter split.

Each row is reduced to a digest of its normalised text. Misra-Gries summaries, one
per task, name every digest that may hold a share ``phi`` of all rows; their exact
counts and winners are then verified and broadcast, so rows of frequent digests are
decided where they are read. All other digests are shuffled in the ordinary way,
and none of them holds more than ``phi`` of the rows.

Defined results: null text counts as empty; rows with equal text and equal ``doc_id``
are ordered by their place in the table, so that exactly one row of a group stays;
a null ``doc_id`` ranks behind every other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.llm.fates import staying, text_key
from docsift.scratch import written

#: Removed before texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: Share of the rows from which a digest counts as frequent, and counters of a summary.
PHI, COUNTERS = 1 / 1000, 4000


def normalised(text: Column) -> Column:
    """Text without ASCII white space; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    for ch in WHITE_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def misra_gries(counts: dict, more: dict, k: int) -> dict:
    """Add counts to a summary of at most ``k`` counters.

    Every counter is at most its key's true count, and short of it by at most
    (rows seen) / (k + 1).
    """
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {key: n - cut for key, n in counts.items() if n > cut}


def _summaries(column: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            seen = batch.column(column).value_counts()
            more = dict(zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True))
            counts = misra_gries(counts, more, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], [column, "low"]
        )

    return run


def frequent_keys(facts: DataFrame, key: str, phi: float = PHI, counters: int = COUNTERS) -> DataFrame:
    """Every binary ``key`` that may hold ``phi`` of the rows.

    At most 1 / (phi - 1 / (counters + 1)) keys come back, whatever the input, which
    bounds what is broadcast.
    """
    n = facts.count()
    least = max(1.0, n * phi - n / (counters + 1))
    found = facts.select(key).mapInArrow(_summaries(key, counters), f"{key} binary, low long")
    return found.groupBy(key).agg(F.sum("low").alias("low")).filter(F.col("low") >= least).select(key)


def winners(facts: DataFrame, frequent: DataFrame, key: str, rank: Column) -> DataFrame:
    """Exact count and best rank of the frequent keys; partial sums are made where rows are read."""
    return (
        facts.join(F.broadcast(frequent), key, "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("w_size"), F.max(rank).alias("w_rank"))
    )


def _rank(n_chars: str, doc_id: str, row_id: str) -> Column:
    """Largest is best: most code points, then smallest doc_id (null last), then first row."""
    return F.struct(F.col(n_chars), (-F.col(doc_id)).alias("neg_id"), (-F.col(row_id)).alias("neg_row"))


def decisions(docs: DataFrame, phi: float = PHI, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    clean = normalised(F.col("text"))
    facts = written(
        docs.select(
            "doc_id",
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
            F.unhex(F.sha2(clean, 256)).alias("digest"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "exact-facts",
    )
    facts = facts.withColumn("rank", _rank("chars", "doc_id", "row_id"))
    best = winners(facts, frequent_keys(facts, "digest", phi, counters), "digest", F.col("rank"))
    marked = facts.join(F.broadcast(best), "digest", "left")
    group = Window.partitionBy("digest")
    rare = marked.filter(F.col("w_size").isNull()).select(
        "doc_id", "digest", "rank", F.count(F.lit(1)).over(group).alias("size"), F.max("rank").over(group).alias("best")
    )
    hot = marked.filter(F.col("w_size").isNotNull()).select(
        "doc_id", "digest", "rank", F.col("w_size").alias("size"), F.col("w_rank").alias("best")
    )
    return hot.unionByName(rare).select(
        "doc_id",
        (-F.col("best.neg_id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, phi: float = PHI, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Who stays is settled on narrow rows, written once; texts are hashed for it in one pass
    and meet the verdicts in another. Of rows with equal id and text one stays.
    """
    facts = written(
        docs.select(
            "doc_id",
            text_key().alias("key"),
            F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"),
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        ),
        "exact-facts",
    )
    rank = F.struct("chars", (-F.col("doc_id")).alias("neg_id"), "key")
    facts = facts.withColumn("rank", rank)
    best = written(winners(facts, frequent_keys(facts, "digest", phi, counters), "digest", F.col("rank")), "exact-winners")
    marked = facts.join(F.broadcast(best), "digest", "left")  # as many as frequent_keys may find
    group = Window.partitionBy("digest")
    rare = marked.filter(F.col("w_size").isNull()).withColumns({"size": F.count(F.lit(1)).over(group), "best": F.max("rank").over(group)}).filter("size > 1")
    hot = marked.filter(F.col("w_size").isNotNull())
    judged = hot.select("doc_id", "key", (F.col("rank") == F.col("w_rank")).alias("stays")).unionByName(rare.select("doc_id", "key", (F.col("rank") == F.col("best")).alias("stays")))
    fate = judged.groupBy(F.col("doc_id").alias("id"), "key", "stays").agg(F.count(F.lit(1)).alias("n"))
    return staying(docs, fate, "exact-fate")
