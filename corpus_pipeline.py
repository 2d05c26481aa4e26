"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and
returns a DataFrame; :func:`run` writes it to the shared folder and reads it back as the
next stage's ``docs``. All but the last return the columns of ``documents``, and further
columns, whatever their names, as they are. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsift.llm import exact_dedup, near_copies, packing, quality, repeats
from docsift.llm.queries import tokenizer_path
from docsift.scratch import written
from docsift.session import bounded_batches, ship


def _ready(spark: SparkSession) -> None:
    """Executors have the package, and whole texts go to Python in batches of a few MB from here on."""
    ship(spark)
    bounded_batches(spark)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and blank texts stay, repeated rows are judged alike."""
    _ready(spark)
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the smallest doc_id (null last).

    White space does not count, null texts count as empty, and of rows that repeat one stays.
    """
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose 5-word shingles have a Jaccard similarity of 0.8 or more.

    It is the one with the smallest doc_id. Found by SimHash and BK-trees, each link checked
    exactly. Null and blank texts are copies of each other.
    """
    _ready(spark)
    return near_copies.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words, or of 400 bytes or more, that repeat are cut from the texts.

    Every copy of such a passage goes. A text of which nothing is left stays as an empty one.
    """
    _ready(spark)
    return repeats.drop_repeats(docs, more=(repeats.PASSAGES,))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining texts in sequences of 4096 tokens; null and empty texts are their closing token."""
    _ready(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_good),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the search for near copies; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
