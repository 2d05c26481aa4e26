"""Dropping rows of a table by verdicts on narrow rows.

A row is named by its id and a hash of its text, so verdicts are worked out without the
texts, and only those on rows that go, or that stand in the table again, meet the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.scratch import written


def text_key() -> Column:
    return F.xxhash64("text")


def staying(docs: DataFrame, fate: DataFrame, tag: str) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    ``fate`` (id, key, stays, n) has the rows that go and the ``n`` > 1 equal rows of which
    one stays; it may have others that stay.
    """
    fate = written(fate.filter("NOT stays OR n > 1").select("id", "key", "stays"), tag)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    texts = docs.select(whole, F.col("doc_id").alias("own_id"), text_key().alias("own"))
    judged = texts.join(fate, (F.col("own") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("id")), "left").filter("stays IS NOT FALSE")
    if not fate.filter("stays").limit(1).count():
        return judged.select("whole.*")  # no row that stays is repeated, so the texts need not be dealt out a second time
    again = judged.filter("stays").dropDuplicates(["own_id", "own"])
    return judged.filter("stays IS NULL").unionByName(again).select("whole.*")
