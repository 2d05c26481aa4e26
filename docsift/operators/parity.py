"""Comparison of two renditions of a text: what of one has no counterpart in the other.

Blocks are non-blank lines. A block's shingles are looked up among the other rendition's
distinct shingles, so the work is linear in the texts, order does not matter, and as
shingles run across line ends, neither does wrapping. Both renditions of a text meet once, by
their key; no row is made for a shingle.

:func:`counterparts` is stricter: it names the one block of the other texts that has most of
a block, by a set-similarity join, so fragments that lie scattered are no counterpart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docsift.functions import text as T
from docsift.scratch import written
from docsift.sources import documents

#: Words of a shingle, share of a block's shingles below which it is missing, least length
#: of a block that is judged, and characters of it that are shown.
SHINGLE, MISSING, LEAST, SHOWN = 3, 0.6, 20, 80
#: Characters within which the next block is looked for as a whole.
NEAR = 512
_SPACE = re.compile(T.SPACE)
#: Bytes of ``T.NOT_TERM`` to spaces; those of further characters are none of a term's.
_BLANKS = bytes(32 if re.match(T.NOT_TERM, chr(b)) else b for b in range(256))


def shingles(words: Column, k: int = SHINGLE) -> Column:
    """Runs of k terms; of fewer terms, the run of all of them."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))


def blocks(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, block_no, text) of the lines that are judged."""
    lines = texts.select("key", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_no", "line"))
    return lines.select("key", "block_no", T.squeezed(F.col("line")).alias("text")).filter(F.length("text") >= least)


def _terms(text: str) -> list[bytes]:
    """``T.terms`` of a text."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


def _runs(terms: list[bytes]) -> list[bytes]:
    return [b" ".join(terms[i : i + SHINGLE]) for i in range(len(terms) - SHINGLE + 1)]


def judged(one: str, two: str, least: int = LEAST) -> Iterator[tuple[int, str, float]]:
    """(block_no, text, ratio) of each block of ``one``: the share of its shingles that are in ``two``.

    A block with fewer terms than a shingle is looked for by its terms one by one. A block that
    goes on in ``two`` where the one before ended, or a little later, has all its shingles there;
    only for others are they looked up, among those of ``two``, which are taken apart once.
    """
    words = _terms(two)
    there, at = b" %s " % b" ".join(words), 0
    known = None
    for block_no, text in enumerate(one.split("\n")):
        if len(text) < least:
            continue
        if "  " in text or not text.isprintable():  # other white space than the space is not printable
            text = _SPACE.sub(" ", text)
        text = text.strip(" ")
        if len(text) < least:
            continue
        terms = _terms(text)
        wanted = b" %s " % b" ".join(terms)
        found = there.find(wanted, at, at + NEAR + len(wanted)) if terms else -1
        if found >= 0:
            at = found + len(wanted) - 1
            yield block_no, text, 1.0
            continue
        if known is None:
            known = {*words, *_runs(words)}
        parts = _runs(terms) or terms
        yield block_no, text, sum(p in known for p in parts) / max(len(parts), 1)


def compare_blocks(one: DataFrame, two: DataFrame, least: int = LEAST, missing: float = MISSING) -> DataFrame:
    """(key, block_no, text, best_ratio, missing) for the blocks of ``one`` (key, text) in ``two`` (key, text)."""
    schema = "key long, block_no int, text string, ratio double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        for key, mine, other in documents.each_row(batches):
            for block_no, text, ratio in judged(mine or "", other or "", least):
                yield {"key": key, "block_no": block_no, "text": text[:SHOWN], "ratio": ratio}, len(text)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    both = one.select(F.col("key").cast("long").alias("key"), "text").join(two.select("key", F.col("text").alias("other")), "key", "left")
    rows = both.mapInArrow(lambda batches: documents.in_batches(each(batches), arrow), schema)
    return rows.select("key", "block_no", "text", F.round("ratio", 6).alias("best_ratio")).withColumn("missing", F.col("best_ratio") < missing)


def stretches(texts: DataFrame, lines: int = 1) -> DataFrame:
    """(key, first, n, terms): each run of up to ``lines`` consecutive non-blank lines that has terms.

    ``first`` is the number of its first line in the text. Runs of more than one line have a
    block whole that the other rendition has wrapped.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "^\ufeff", "")
    numbered = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("no"), T.terms(x).alias("terms"))), lambda x: F.size(x["terms"]) > 0)
    terms = lambda x, i, n: x["terms"] if n == 1 else F.flatten(F.transform(F.slice("lines", i + 1, F.lit(n)), lambda y: y["terms"]))
    runs = lambda x, i: F.array(*[F.when(i + n <= F.size("lines"), F.struct(x["no"].alias("first"), F.lit(n).alias("n"), terms(x, i, n).alias("terms"))) for n in range(1, lines + 1)])
    # made in the text's row, so that no row of a line has the whole text beside it
    each = texts.select("key", numbered.alias("lines")).select("key", F.explode(F.flatten(F.transform("lines", runs))).alias("r")).filter("r IS NOT NULL")
    return each.select("key", "r.first", "r.n", "r.terms")


def counterparts(one: DataFrame, two: DataFrame, least: float = MISSING, lines: int = 1, same_key: bool = False, shortest: int = LEAST) -> DataFrame:
    """(key, block_no, n_shingles, ratio, other, first, n_lines, missing) for each block of ``one`` (key, text).

    Its best counterpart among the stretches of up to ``lines`` lines of ``two`` (key, text):
    the one with the largest share of the block's distinct shingles, if that is ``least`` or
    more (of equal ones the shortest stretch, then the smallest key and line); else nothing
    is named and the block is missing. With ``same_key``, only texts of the same key are looked at.

    A set-similarity join: a stretch that has that share must have one of the block's
    rarest shingles, as many as may be lacking and one more; only these are looked up, and
    only stretches of enough shingles pass. What passes is counted exactly. Equal stretches
    are compared once. Null texts have no blocks; blocks without terms are missing.
    """
    by = ["key"] if same_key else []
    keyed = blocks(one, shortest).select("key", "block_no", F.array_distinct(shingles(T.terms(F.col("text")))).alias("parts"))
    keyed = written(keyed.withColumn("n_shingles", F.size("parts")), "parity-blocks")
    wanted = written(keyed.select("key", "block_no", "n_shingles", F.explode("parts").alias("part")), "parity-parts")
    looked_up = wanted.select(*by, "part").distinct()
    sets = stretches(two, lines).withColumn("parts", F.array_distinct(shingles(F.col("terms"))))
    # before its shingles become rows: else each of them has the stretch's terms beside it
    sets = sets.select("key", "first", "n", F.unhex(F.md5(F.array_join("terms", " "))).alias("stretch"), F.size("parts").alias("size"), "parts")
    sets = sets.select("key", "first", "n", "stretch", "size", F.explode("parts").alias("part"))
    hits = written(sets.join(looked_up, [*by, "part"], "left_semi"), "parity-hits")
    of = [*by, "stretch"]
    where = hits.groupBy(*of, "size").agg(F.min(F.struct("n", "key", "first")).alias("at"))
    there = written(hits.select(*of, "size", "part").distinct(), "parity-shared")
    rarity = there.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("key", "block_no").orderBy(F.coalesce("n", F.lit(0)), "part"))
    needed = F.ceil(F.col("n_shingles") * least - 1e-9).cast("int")
    ranked = wanted.join(rarity, [*by, "part"], "left").withColumn("place", place).withColumn("needed", F.greatest(needed, F.lit(1)))
    prefix = ranked.filter(F.col("place") <= F.col("n_shingles") - F.col("needed") + 1).select(F.col("key").alias("block_key"), "block_no", "n_shingles", "needed", "part", *by)
    met = prefix.join(there, [*by, "part"]).filter(F.col("size") >= F.col("needed")).select(*by, "block_key", "block_no", "n_shingles", "needed", "stretch", "size").distinct()
    shared = met.join(there.select(*of, "part"), of).join(wanted.select(F.col("key").alias("block_key"), "block_no", "part"), ["block_key", "block_no", "part"])
    shared = shared.groupBy("block_key", "block_no", "n_shingles", "needed", *of, "size").agg(F.count(F.lit(1)).alias("common")).filter(F.col("common") >= F.col("needed"))
    best = F.min(F.struct((-F.col("common")).alias("minus"), "size", "at"))
    found = shared.join(where.drop("size"), of).groupBy("block_key", "block_no").agg(best.alias("b"))
    found = found.select(F.col("block_key").alias("key"), "block_no", (-F.col("b.minus")).alias("common"), F.col("b.at.key").alias("other"), F.col("b.at.first").alias("first"), F.col("b.at.n").alias("n_lines"))
    ratio = F.round(F.col("common") / F.col("n_shingles"), 6)
    rows = keyed.drop("parts").join(found, ["key", "block_no"], "left")
    return rows.select("key", "block_no", "n_shingles", ratio.alias("ratio"), "other", "first", "n_lines", F.col("common").isNull().alias("missing"))


def similarity(one: DataFrame, two: DataFrame) -> DataFrame:
    """(key, similarity): common terms over all terms, repeats included, of texts with one key."""
    count = lambda df, name: df.select("key", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias(name))
    both = count(one, "a").join(count(two, "b"), ["key", "term"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.groupBy("key").agg(F.round(F.sum(F.least(a, b)) / F.sum(F.greatest(a, b)), 6).alias("similarity"))


def with_lacking(rows: DataFrame, one: str = "text", two: str = "pdf_text") -> DataFrame:
    """In place of the texts ``one`` and ``two``, ``lacking``: the blocks (block_no, text) of one without a counterpart; null if either is."""
    kept = [c for c in rows.columns if c not in (one, two)]
    struct = "array<struct<block_no:int,text:string>>"
    kind = to_arrow_schema(StructType.fromDDL(f"lacking {struct}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for mine, other in documents.each_row([batch.select([one, two])]):
                found.append(None if mine is None or other is None else [{"block_no": n, "text": t[:SHOWN]} for n, t, ratio in judged(mine, other) if round(ratio, 6) < MISSING])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], names=[*kept, "lacking"])

    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(f"lacking {struct}").fields])
    return rows.mapInArrow(run, schema)


def parity_check() -> tuple[str, str, Column, Column, str]:
    """The check ``parity.docx_pdf`` over ``lacking``; null without a PDF, or if either cannot be read."""
    n = F.size("lacking")
    named = F.array_join(F.transform("lacking", lambda x: F.concat(F.lit('"'), x["text"], F.lit('"'))), "; ")
    detail = F.when(F.col("lacking").isNull(), F.lit("nothing to compare")).when(n > 0, F.concat(n.cast("string"), F.lit(" block(s) have no counterpart: "), named)).otherwise(F.lit(""))
    return "parity.docx_pdf", "Every block is in the PDF", F.when(F.col("lacking").isNotNull(), n == 0), detail, "high"
