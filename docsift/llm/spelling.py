"""Spelling variants: words one edit apart, the common form of each, and the root it leads to.

Every word emits itself and its distinct single deletions, as hashes; words that share one
meet by an equi-join. A deletion that two words share at a common place is a replacement, one
that is itself a word is an insertion or deletion; anything else that meets is farther
apart and goes. As both words' letters stand in the row, the distance is checked exactly.
Rows that a hash can bring together are as many as the alphabet times the word's length, so
no key is hot however often a word occurs.

Words of more than ``LONG`` letters would be carried as often as they have letters; their
keys travel with an id of 64 bits, and the words join again where keys have met.

A form is at least twice as frequent as its word, so chains end; roots come by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.scratch import discard, written

#: Letters of a word at least, its occurrences at least, how often a damage is simulated, and
#: how many times as frequent a form is.
LEAST_LETTERS, LEAST_COUNT, DAMAGED, TIMES = 5, 3, 97, 2
#: Letters up to which a word travels with its keys.
LONG = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(doc_id, run): each run of letters of at least ``least``, A-Z in lower case; null texts have none."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    each = docs.select("doc_id", F.explode(F.split(lowered, "[^a-z\\u00C0-\\u00FF]+")).alias("run"))
    return each.filter(F.length("run") >= least)


def damaged(run: Column, doc_id: Column, one_in: int = DAMAGED) -> Column:
    """The run without one letter where a checksum of document and run says so; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    place = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.left(run, place), F.substring(run, place + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, one_in: int = DAMAGED) -> DataFrame:
    """(word, n) of all documents, after :func:`damaged`."""
    each = runs(docs, least_letters).select(damaged(F.col("run"), F.col("doc_id"), one_in).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter((F.length("word") >= least_letters) & (F.col("n") >= least_count))


def _keys(words: DataFrame, *carried: str) -> DataFrame:
    """Adds (key, first, last): the word itself at no place (0), and each distinct deletion with the places that give it."""
    letter = lambda i: F.substring(F.col("word"), i, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), F.length("word")), lambda i: (i == 1) | (letter(i) != letter(i - 1)))
    rows = words.select(*carried, "word", starts.alias("starts"))
    without = lambda i: F.concat(F.left(F.col("word"), i - 1), F.substring(F.col("word"), i + 1, F.length("word")))
    deleted = F.transform("starts", lambda i, k: F.struct(F.xxhash64(without(i)).alias("key"), i.alias("first"), F.coalesce(F.get("starts", k + 1) - 1, F.length("word")).alias("last")))
    own = F.array(F.struct(F.xxhash64("word").alias("key"), F.lit(0).alias("first"), F.lit(0).alias("last")))
    return rows.select(*carried, F.inline(F.concat(own, deleted)))


def _met(keys: DataFrame, name: str) -> DataFrame:
    """(a, b, a_n, b_n): ordered pairs of ``name`` that share a key such that they can be one edit apart."""
    one, two = keys.alias("x"), keys.alias("y")
    inserted = (F.col("x.first") == 0) != (F.col("y.first") == 0)
    replaced = (F.col("x.first") > 0) & (F.col("x.first") <= F.col("y.last")) & (F.col("y.first") <= F.col("x.last"))
    pairs = one.join(two, F.col("x.key") == F.col("y.key")).filter((F.col(f"x.{name}") != F.col(f"y.{name}")) & (inserted | replaced))
    return pairs.select(F.col(f"x.{name}").alias("a"), F.col(f"y.{name}").alias("b"), F.col("x.n").alias("a_n"), F.col("y.n").alias("b_n"))


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b, a_n, b_n): ordered pairs of words (word, n) exactly one inserted, deleted or replaced letter apart."""
    near = F.levenshtein("a", "b", 1) == 1
    short = _met(_keys(words.filter(F.length("word") <= long).withColumn("w", F.col("word")), "w", "n"), "w").filter(near)
    ids = words.filter(F.length("word") >= long).withColumn("id", F.xxhash64("word"))
    met = _met(_keys(ids, "id", "n"), "id").select("a", "b").distinct()
    name = lambda side: ids.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n"))
    far = met.join(name("a"), "a").join(name("b"), "b").select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n")
    far = far.filter((F.greatest(F.length("a"), F.length("b")) > long) & near)
    return short.unionByName(far)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word with a form: where the forms lead. Chains halve in each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("then"))
        then = written(now.join(on, "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")), "spelling-roots")
        moved = then.filter("moved").limit(1).count()
        discard(now)
        now = then.drop("moved")
        now._docsift_path = then._docsift_path
        if not moved:
            return now


def variants(words: DataFrame, times: int = TIMES, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word (word, n), words being distinct.

    ``form`` is the near word of largest n, of these the smallest in code-point order, if it
    is ``times`` as frequent, else null; ``root`` is where forms lead, or the word itself.
    """
    words = written(words.select("word", "n"), "spelling-words")
    near = near_pairs(words, long)
    top = near.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b"))).alias("best"))
    rows = words.join(top.withColumnRenamed("a", "word"), "word", "left")
    counts = -F.col("best.minus")
    has = counts >= F.col("n") * times
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.b")).alias("form"), F.when(has, counts).alias("form_n"))
    rows = written(rows, "spelling-forms")
    roots = _roots(rows.filter("form IS NOT NULL"))
    joined = rows.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
