"""Stupid-backoff scores of all documents under a model of all documents.

The score of a word after another is c(pair) / c(first word), or where the pair is not
known ``ALPHA`` times the share of the word among all words. Counts are of the whole
corpus less the document's own, so no text is judged by itself; a word that no other
document has counts as one more step back, ``ALPHA`` times one word in all.

Relations, with documents dealt to blocks of bounded size by a hash:

* ``grams``: the distinct n-grams of a block with their counts, exploded into one row for
  each hash range (bucket), a range's hashes side by side in order;
* ``totals``: the count table, partitioned by hash. A bucket's rows meet in one task, are
  summed by hash and joined back to the rows they came from;
* the totals return to their blocks, where each document's n-grams look theirs up and are
  summed per document.

A frequent n-gram is one entry of each block, so it is no larger to its bucket than any
other; all tables grow with the input and none is broadcast.

N-grams are told apart by 64-bit hashes. Words are as in the document fingerprints.
Defined results: null counts as empty, which has no tokens, score 0 and a null perplexity;
repeated rows are documents of their own; a null id is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm._columns import raw_text
from docsift.llm.repeats import _mixed
from docsift.llm.sketches import word_hashes
from docsift.scratch import written

ALPHA = 0.4
#: Text of a block, and distinct n-grams of a bucket (8 bytes each), in bytes.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
_U = np.uint64


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts are mostly ones and twos, which a general compressor makes small."""
    return zstandard.compress(counts.astype("<u8").tobytes(), 1)


def _counts(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data.as_buffer()), "<u8").astype(np.int64)


class Block:
    """N-grams of the texts of a block."""

    def __init__(self, texts: pa.Array) -> None:
        words, first = word_hashes(*raw_text(texts))
        self.words, self.first = words, first
        self.sizes = np.diff(first)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        follows = np.ones(len(words), bool)
        follows[first[:-1][self.sizes > 0]] = False
        self.second = np.flatnonzero(follows)
        self.pairs = _mixed(words[self.second - 1] * _U(0x9E3779B97F4A7C15) + _mixed(words[self.second] + _U(1)))

    def distinct(self, order: int, inverse: bool = False):
        return np.unique(self.words if order == 1 else self.pairs, return_inverse=inverse, return_counts=True)


def _range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; rises with the hash."""
    return ((hashes >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _grams(buckets: int):
    """Rows (block, text) sorted by block to rows (block, bucket, gram, hashes, counts)."""

    def rows(block: int, texts: list[pa.Array]) -> pa.RecordBatch:
        found = Block(pa.concat_arrays(texts))
        out: list[tuple] = []
        for order in (1, 2):
            hashes, counts = found.distinct(order)
            number = _range_of(hashes, buckets)
            heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
            for a, b in zip(heads, [*heads[1:], len(number)], strict=False):
                out.append((block, int(number[a]), order, hashes[a:b].tobytes(), _squeezed(counts[a:b])))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], ["block", "bucket", "gram", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = None, []
        for batch in batches:
            blocks = np.asarray(batch.column("block"))
            heads = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]) if len(blocks) else []
            for a, b in zip(heads, [*heads[1:], len(blocks)], strict=False):
                if blocks[a] != now:
                    if texts:
                        yield rows(now, texts)
                    now, texts = int(blocks[a]), []
                texts.append(batch.column("text").slice(a, b - a))
        if texts:
            yield rows(now, texts)

    return run


def _totals(batches: pa.Table) -> pa.Table:
    """Rows of one bucket and gram length: each hash's count over all blocks, row by row."""
    hashes = [np.frombuffer(x.as_buffer(), _U) for x in batches.column("hashes")]
    counts = [_counts(x) for x in batches.column("counts")]
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)[at]  # exact below 2 ** 53
    ends = np.cumsum([len(x) for x in hashes])
    parts = [_squeezed(x) for x in np.split(total, ends[:-1])]
    return pa.table({"block": batches.column("block"), "bucket": batches.column("bucket"), "gram": batches.column("gram"), "totals": pa.array(parts, pa.binary())})


def _own(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document."""
    _, back, n = np.unique(doc << 40 | at, return_inverse=True, return_counts=True)
    return n[back]


def _scores(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """Texts and totals of one block to sums per document."""
    block = Block(docs.column("text").combine_chunks())
    n = len(block.sizes)
    looked: dict[int, np.ndarray] = {}
    order = np.lexsort((totals.column("bucket"), totals.column("gram")))
    grams, parts = np.asarray(totals.column("gram")), totals.column("totals")
    for gram in (1, 2):
        looked[gram] = np.concatenate([np.zeros(0, np.int64), *(_counts(parts[int(i)]) for i in order if grams[i] == gram)])
    _, word_at, _ = block.distinct(1, inverse=True)
    _, pair_at, _ = block.distinct(2, inverse=True)
    word = looked[1][word_at] - _own(block.doc, word_at) if len(word_at) else word_at
    second = block.second
    pair = looked[2][pair_at] - _own(block.doc[second], pair_at) if len(pair_at) else pair_at
    known = pair > 0
    value = np.zeros(len(block.words))
    value[second[known]] = np.log(pair[known]) - np.log(word[second[known] - 1])
    alone = np.ones(len(block.words), bool)  # judged as a single word
    alone[second[known]] = False
    value[alone] = np.where(word[alone] > 0, np.log(np.maximum(word[alone], 1)), math.log(ALPHA))
    value[second[~known]] += math.log(ALPHA)
    total = lambda x, at: np.bincount(at, weights=x, minlength=n)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_tokens": pa.array(block.sizes.astype(np.int64)),
            "n_backoff": pa.array(total(~known, block.doc[second]).astype(np.int64)),
            "n_alone": pa.array(total(alone, block.doc).astype(np.int64)),
            "part": pa.array(total(value, block.doc).astype(np.float64)),
        }
    )


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_backoff, log_score, perplexity.

    log_score is the sum of natural logarithms over the words, perplexity
    exp(-log_score / n_tokens), n_backoff the words whose pair no other document has.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = -(-size // block_bytes) or 1, -(-2 * size // bucket_bytes) or 1
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = texts.withColumn("block", block).repartition(tasks, "block")
    kinds = "block long, bucket long, gram int, hashes binary, counts binary"
    # with the ids, though n-grams don't need them: both uses of the texts then read one and the same exchange
    grams = dealt.sortWithinPartitions("block").select("doc_id", "text", "block").mapInArrow(_grams(buckets), kinds)
    totals = grams.groupBy("bucket", "gram").applyInArrow(_totals, "block long, bucket long, gram int, totals binary")
    kinds = "doc_id long, n_tokens long, n_backoff long, n_alone long, part double"
    parts = written(dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scores, kinds), "lm-parts")
    everything = parts.agg(F.sum("n_tokens")).first()[0] or 0
    others = F.greatest(F.lit(everything) - F.col("n_tokens"), F.lit(1))
    log_score = F.col("part") - F.col("n_alone") * F.log(others.cast("double"))
    scored = parts.select("doc_id", "n_tokens", "n_backoff", log_score.alias("log_score"))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_score") / F.col("n_tokens")))
    return scored.withColumn("perplexity", perplexity)
