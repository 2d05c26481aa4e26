"""Phrases of a dictionary in sequences of terms: runs met by an equi-join, overlaps settled.

Each place of a sequence emits its runs of as many terms as phrases of the dictionary have,
in the singular, and meets the dictionary by equality. A dictionary of bounded size is
broadcast, and only places at which the first two terms of a phrase stand emit anything; how
large it is decides how Spark joins, not how much there is to compare. Where found phrases overlap, the leftmost stands,
and of those that start together the longest. That is settled within stretches of phrases
that overlap one another, so a sequence is never read from its start for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsift.functions import text as T

#: Phrases up to which a dictionary is broadcast; of a larger one all runs are shuffled.
FEW = 100_000


def singular(term: Column) -> Column:
    """Without a plural s; short terms and those in -ss keep theirs."""
    plural = (F.length(term) > 3) & term.endswith("s") & ~term.endswith("ss")
    return F.when(plural, F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(term)


def key(phrase: Column | str) -> Column:
    """Terms of a phrase in the singular, joined by blanks."""
    return F.array_join(F.transform(T.terms(F.col(phrase) if isinstance(phrase, str) else phrase), singular), " ")


def dictionary(aliases: DataFrame) -> DataFrame:
    """(phrase, n, canonical) of the spellings (alias, canonical) of two terms or more.

    A canonical name of several terms is a phrase too. What is both an alias and a canonical
    name stands for what the alias stands for; of several entries for a phrase, the smallest counts.
    """
    name = key("canonical")
    both = aliases.select(key("alias").alias("phrase"), name.alias("canonical"), F.lit(0).alias("rank"))
    both = both.unionByName(aliases.select(name.alias("phrase"), name.alias("canonical"), F.lit(1).alias("rank")))
    both = both.withColumn("n", F.size(F.split("phrase", " "))).filter("n > 1")
    first = F.min(F.struct("rank", "canonical"))
    return both.groupBy("phrase", "n").agg(first.alias("f")).select("phrase", "n", "f.canonical")


def lengths(table: DataFrame) -> list[int]:
    """How many terms the phrases of a dictionary have: a few numbers."""
    return sorted(r["n"] for r in table.select("n").distinct().collect())


def found(rows: DataFrame, table: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """(*keep, place, n, run, canonical): every phrase of ``table`` in the arrays ``terms`` of ``rows``.

    ``sizes`` are the phrases' lengths, see :func:`lengths`. ``place`` counts terms from 0;
    ``run`` is the phrase as it stands in the sequence. ``table`` is read more than once.
    """
    if not sizes:
        none = {"place": "int", "n": "int", "run": "string", "canonical": "string"}
        return rows.select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).filter("false")
    each = rows.select(*keep, "terms", F.posexplode("terms").alias("place", "term"))
    part = lambda i: F.get("terms", F.col("place") + i)
    if table.limit(FEW + 1).count() <= FEW:
        table = F.broadcast(table)
        heads = table.select(F.substring_index("phrase", " ", 2).alias("head")).distinct()
        each = each.withColumn("head", F.concat(singular(F.col("term")), F.lit(" "), singular(part(1)))).join(F.broadcast(heads), "head", "left_semi")
    runs = [
        F.when(F.col("place") + n <= F.size("terms"), F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *map(part, range(n))).alias("run"), F.concat_ws(" ", *[singular(part(i)) for i in range(n)]).alias("phrase")))
        for n in sizes
    ]
    each = each.select(*keep, "place", F.explode(F.array(*runs)).alias("r")).filter("r IS NOT NULL").select(*keep, "place", "r.run", "r.phrase")
    return each.join(table, "phrase").select(*keep, "place", "n", "run", "canonical")


def settled(hits: DataFrame, by: list[str]) -> DataFrame:
    """Of the phrases (*by, place, n, run, canonical) those that stand: leftmost, then longest, without overlaps."""
    best = hits.groupBy(*by, "place").agg(F.max(F.struct("n", "canonical", "run")).alias("h")).select(*by, "place", "h.*")
    order = Window.partitionBy(*by).orderBy("place")
    reach = F.max(F.col("place") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("new", F.coalesce((F.col("place") >= reach).cast("int"), F.lit(1)))
    best = best.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    listed = F.array_sort(F.collect_list(F.struct("place", "n", "run", "canonical")))
    none = F.filter("all", lambda x: F.lit(False))
    start = F.struct(F.lit(0).alias("end"), none.alias("taken"))

    def step(state: Column, x: Column) -> Column:
        free = x["place"] >= state["end"]
        taken = F.when(free, F.concat(state["taken"], F.array(x))).otherwise(state["taken"])
        return F.struct(F.when(free, x["place"] + x["n"]).otherwise(state["end"]).alias("end"), taken.alias("taken"))

    stretches = best.groupBy(*by, "stretch").agg(listed.alias("all"))
    return stretches.select(*by, F.inline(F.aggregate("all", start, step, lambda state: state["taken"])))
