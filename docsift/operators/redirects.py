"""Chains of redirects over a table of answers, each hop held against the URL and address policy.

Nothing is fetched: the answers (url, status, location) are a table. Each round is an
equi-join of the requests still on their way with the answers, and there are as many rounds
as hops are allowed, so a loop ends by itself; it is told apart all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.scratch import written
from docsift.sources import inputs

#: Hops that are followed, and answers that redirect.
MAX_HOPS, REDIRECTS = 3, (301, 302, 303, 307, 308)


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts; none goes above the root."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    none = F.filter(parts, lambda x: F.lit(False))
    kept = F.aggregate(parts, none, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", "..") & ((F.size(kept) == 1) | (F.element_at(kept, -1) != "")), F.lit("/")).otherwise(F.lit("")))


def joined(base: Column, location: Column) -> Column:
    """Where a relative reference leads, for bases with a host."""
    location = F.trim(location)
    whole = "^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)?([^?#]*)([?][^#]*)?"
    scheme, host, path, query = (F.regexp_extract(base, whole, i) for i in range(1, 5))
    own_path = F.regexp_extract(location, "^([^?#]*)", 1)
    rest = F.substring(location, F.length(own_path) + 1, F.length(location))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*/)", 1))
    root = F.concat(scheme, host)
    return (
        F.when(location == "", F.regexp_extract(base, "^([^#]*)", 1))
        .when(location.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), location)
        .when(location.startswith("//"), F.concat(scheme, location))
        .when(location.startswith("#"), F.concat(root, path, query, location))
        .when(location.startswith("?"), F.concat(root, path, location))
        .when(location.startswith("/"), F.concat(root, _without_dots(own_path), rest))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own_path)), rest))
    )


def _asked(url: Column) -> Column:
    """What is asked for: the URL without its fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^([^#]*)", 1)


def follow(requests: DataFrame, answers: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(id, url, final_url, hops, outcome, detail, trail) for each row of requests (id, url).

    Outcomes: ``ok`` with the final URL; ``policy`` where a hop's URL is refused (``detail`` says
    why); ``loop`` where it leads to a URL that was asked for before; ``too many redirects``,
    ``no location``, ``http`` (another status, in ``detail``) and ``unreachable`` (no answer).
    The trail has the URLs asked for. Of several answers for a URL, the first in order counts.
    """
    answer = answers.groupBy(_asked(F.col("url")).alias("asked")).agg(F.min(F.struct("status", "location")).alias("answer"))
    answer = answer.select("asked", "answer.*")
    empty = F.array().cast("array<string>")
    going = requests.select("id", F.col("url").alias("start"), F.col("url").alias("now"), empty.alias("trail"))
    done = []
    for hop in range(hops + 1):
        judged = inputs.url_policy(going, "now").select("id", "start", "now", "trail", F.col("url_error").alias("refused"), _asked(F.col("now")).alias("asked"))
        met = judged.join(answer, "asked", "left")
        blank = F.trim(F.coalesce("location", F.lit(""))) == ""
        then = joined(F.col("now"), F.col("location"))
        turns = F.coalesce(F.col("status").isin(*REDIRECTS), F.lit(False))
        trail = F.concat("trail", F.array("asked"))
        outcome = (
            F.when(F.col("refused").isNotNull(), "policy")
            .when(F.col("status").isNull(), "unreachable")
            .when(turns & blank, "no location")
            .when(turns & F.array_contains(trail, _asked(then)), "loop")
            .when(turns & (F.lit(hop) == hops), "too many redirects")
            .when(turns, F.lit(None))
            .when(F.col("status").between(200, 299), "ok")
            .otherwise("http")
        )
        asked = F.when(F.col("refused").isNull(), trail).otherwise(F.col("trail"))
        rows = written(met.select("id", "start", "now", then.alias("then"), asked.alias("trail"), F.lit(hop).alias("hops"), "status", "refused", outcome.alias("outcome")), "redirects")
        done.append(rows.filter("outcome IS NOT NULL"))
        going = rows.filter("outcome IS NULL").select("id", "start", F.col("then").alias("now"), "trail")
    found = done[0]
    for rows in done[1:]:
        found = found.unionByName(rows)
    detail = F.when(F.col("outcome") == "policy", F.col("refused")).when(F.col("outcome") == "http", F.col("status").cast("string"))
    return found.select("id", F.col("start").alias("url"), F.when(F.col("outcome") == "ok", F.col("now")).alias("final_url"), "hops", "outcome", detail.alias("detail"), "trail")
