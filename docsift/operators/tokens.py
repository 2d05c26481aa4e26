"""Families of rotated tokens: each exchange makes a token the parent of the next.

A family is found by pointer doubling: every token knows an ancestor and how far away it is,
and in each round asks that ancestor for its own, so a chain of n tokens takes log n joins.
What undoes a family, a revocation or a second use of a token that is consumed, reaches all
of its tokens, whichever of them it came by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.operators.staging import TTL_REFRESH
from docsift.scratch import discard, written


def families(tokens: DataFrame) -> DataFrame:
    """(token, root, depth) of tokens (token, parent), tokens being distinct.

    A token without a parent, or whose parent is not there, is a root. Where parents go
    round in a circle there is none: root and depth are null, for what hangs on it as well.
    """
    named = tokens.filter("token IS NOT NULL").select("token", "parent")
    known = named.select(F.col("token").alias("parent"), F.lit(True).alias("known"))
    linked = named.join(known, "parent", "left").select("token", F.when(F.col("known"), F.col("parent")).alias("up"))
    now = written(linked.select("token", F.coalesce("up", "token").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNull().alias("done")), "families")
    rounds = now.count().bit_length() + 1  # by then every chain has ended
    for _ in range(rounds):
        if not now.filter("NOT done").limit(1).count():
            break
        on = now.select(F.col("token").alias("root"), F.col("root").alias("then"), F.col("depth").alias("more"), F.col("done").alias("then_done"))
        going = now.filter("NOT done").join(on, "root")
        going = going.select("token", F.col("then").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("then_done").alias("done"))
        then = written(now.filter("done").unionByName(going), "families")
        discard(now)
        now = then
    return now.select("token", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def liveness(tokens: DataFrame, uses: DataFrame, revoked: DataFrame, now: int, ttl: int = TTL_REFRESH) -> DataFrame:
    """(token, root, depth, state, undone_at) at the second ``now``.

    ``tokens`` (token, parent, at), ``uses`` (token, at, use_id): attempts to exchange, of which
    a token's first one consumes it and any other is a reuse; ``revoked`` (token, at). Times are
    seconds, and nothing later than ``now`` counts. States: ``revoked`` where the family is
    undone, else ``consumed``, ``expired`` (older than ``ttl``) or ``live``.
    """
    named = written(families(tokens), "token-families")
    tried = uses.filter((F.col("at") <= now) & F.col("token").isNotNull()).select("token", F.struct("at", "use_id").alias("use"))
    first = tried.groupBy("token").agg(F.min("use").alias("first"))
    again = tried.join(first, "token").filter("use > first").groupBy("token").agg(F.min("use.at").alias("undone"))
    ended = again.unionByName(revoked.filter(F.col("at") <= now).groupBy("token").agg(F.min("at").alias("undone")))
    undone = ended.join(named.select("token", "root"), "token").groupBy("root").agg(F.min("undone").alias("undone_at")).filter("root IS NOT NULL")
    rows = named.join(tokens.select("token", "at"), "token").join(first.select("token", F.lit(True).alias("used")), "token", "left").join(undone, "root", "left")
    state = (
        F.when(F.col("undone_at").isNotNull() | F.col("root").isNull(), "revoked")
        .when(F.col("used"), "consumed")
        .when(F.lit(now) - F.col("at") > ttl, "expired")
        .otherwise("live")
    )
    return rows.select("token", "root", "depth", state.alias("state"), "undone_at")
