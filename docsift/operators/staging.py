"""Staged inputs and sign-in as queries over event logs.

Inputs are staged once, expire, and are taken once. Sign-in codes and tokens are the same
with a client bound to them. Expiry is strict: at exactly the time limit, a thing still
counts. The streaming form of staging is in ``docsift.streaming.staging``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from docsift.scratch import discard, written

#: Seconds that staged inputs, codes, access and refresh tokens and pending
#: sign-ins live; entries and bytes that may be staged; failures in a trailing span of
#: seconds that lock sign-in out.
TTL_STAGED, TTL_CODE, TTL_ACCESS, TTL_REFRESH, TTL_PENDING = 1800, 300, 3600, 30 * 86400, 600
MAX_ENTRIES, MAX_TOTAL_BYTES, MAX_BYTES = 16, 64 * 1024 * 1024, 12 * 1024 * 1024
LOCKOUT_FAILURES, LOCKOUT_SECONDS = 8, 300
#: What is said of an unknown, a used and an expired id alike.
GONE = "unknown, already used or expired"


def first_takes(takes: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Of the attempts to take a thing, the first one."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(ts, order))
    return takes.withColumn("place", place).filter("place = 1").drop("place")


def takes(puts: DataFrame, taken: DataFrame, ttl: int = TTL_STAGED) -> DataFrame:
    """(take_id, id, at, ok, message) for takes (take_id, id, at) of puts (id, at), times in seconds.

    Only the first take of a live id succeeds; every other outcome has the same message.
    """
    rows = taken.join(puts.select("id", F.col("at").alias("put_at")), "id", "left")
    live = F.col("put_at").isNotNull() & (F.col("at") >= F.col("put_at")) & (F.col("at") - F.col("put_at") <= ttl)
    before = Window.partitionBy("id").orderBy("at", "take_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(live.cast("int")).over(before), F.lit(0)) == 1
    ok = live & ~used
    return rows.select("take_id", "id", "at", ok.alias("ok"), F.when(~ok, F.lit(GONE)).alias("message"))


def live_entries(puts: DataFrame, at: str, bytes_column: str, ttl: int = TTL_STAGED) -> DataFrame:
    """``puts`` with the number and bytes of entries that live when each is put, itself included.

    The store is one, so its entries are ordered as a whole; its own caps keep it small.
    For many stores, give the store's name in a column ``store``.
    """
    by = Window.partitionBy("store") if "store" in puts.columns else Window.partitionBy(F.lit(0))
    span = by.orderBy(at).rangeBetween(-ttl, 0)
    return puts.withColumns({"n_live": F.count(F.lit(1)).over(span), "live_bytes": F.sum(bytes_column).over(span)})


def _folded(rows: DataFrame, key: str, order: list[str], step, name: str) -> DataFrame:
    """``rows`` with ``step``'s answer to each row of a key, in order, as a column ``name``.

    ``step`` makes a function of a row (dict) for each key, which holds what that key's rows
    have come to. What a row does depends on what became of those before it, so a key's rows
    are read one after another; they pass by in batches, and only the state is held.
    """
    schema = StructType([*rows.schema.fields, StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, answer = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if answer is None or row[key] != now:
                    now, answer = row[key], step()
                out.append(answer(row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, name])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


class Store:
    """What one store holds: (at, bytes, id) of at most ``max_entries`` entries, oldest first."""

    def __init__(self, ttl: int = TTL_STAGED, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL_BYTES, held: list[tuple] | None = None) -> None:
        self.ttl, self.max_bytes, self.max_entries, self.max_total = ttl, max_bytes, max_entries, max_total
        self.held = list(held or [])

    def _expire(self, at) -> None:
        self.held = [x for x in self.held if at - x[0] <= self.ttl]

    def take(self, at, ident) -> str | None:
        """Releases an entry; says so if there is none."""
        self._expire(at)
        left = [x for x in self.held if x[2] != ident]
        gone = len(left) == len(self.held)
        self.held = left
        return GONE if gone else None

    def put(self, at, size: int, ident) -> str | None:
        """Stages an entry, or says why not: empty, too large, too many entries, too many bytes, in that order."""
        self._expire(at)
        if size == 0:
            return "empty"
        if size > self.max_bytes:
            return "too large"
        if len(self.held) >= self.max_entries:
            return "too many entries"
        if sum(x[1] for x in self.held) + size > self.max_total:
            return "too many bytes"
        self.held.append((at, size, ident))
        return None


def put_errors(
    puts: DataFrame, at: str = "at", bytes_column: str = "bytes", order: tuple[str, ...] = (), taken: DataFrame | None = None,
    ttl: int = TTL_STAGED, max_bytes: int = MAX_BYTES, max_entries: int = MAX_ENTRIES, max_total: int = MAX_TOTAL_BYTES,
) -> DataFrame:
    """Adds ``error`` to puts: empty, too large, too many entries, too many bytes, in that order.

    Only what the store holds counts: puts that it refused, entries that have expired and
    those that ``taken`` (id, at; puts need an id then) has released do not. A column
    ``store`` names the store, else there is one. ``order`` settles the order of puts of the
    same time; a take comes before the puts of its time.
    """
    names = puts.columns
    own = "store" if "store" in names else None
    ident = F.col("id").cast("string") if "id" in names else F.lit(None).cast("string")
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    ties = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0).alias("none"))
    store = F.col(own).cast("string") if own else F.lit("")
    size = F.coalesce(F.col(bytes_column), F.lit(0)).cast("long")
    rows = puts.select(store.alias("in_store"), F.col(at).alias("when"), F.lit(1).alias("turn"), ties.alias("ties"), ident.alias("ident"), size.alias("n"), whole.alias("whole"))
    if taken is not None:
        store = F.col(own).cast("string") if own else F.lit("")
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ties", "n", "whole")]
        gone = taken.select(store.alias("in_store"), F.col("at").alias("when"), F.lit(0).alias("turn"), none[0], F.col("id").cast("string").alias("ident"), none[1], none[2])
        rows = rows.unionByName(gone)

    def step():
        own = Store(ttl, max_bytes, max_entries, max_total)
        return lambda row: own.put(row["when"], row["n"], row["ident"]) if row["turn"] else own.take(row["when"], row["ident"])

    return _folded(rows, "in_store", ["when", "turn", "ties"], step, "error").filter("turn = 1").select("whole.*", "error")


def short_ids(keys: DataFrame, key: str = "key", digits: int = 5, attempts: int | None = None) -> DataFrame:
    """(key, id, attempts): an id of so many hexadecimal digits for each distinct key, no two alike.

    An id is the start of a digest of the key and the number of the attempt. In each round
    the keys without one claim theirs; of those that claim an id which nobody holds, the
    smallest key gets it, and only the others try again. So ids do not depend on how the
    keys are partitioned. Keys are text or numbers; null has no id. Without a number of
    ``attempts`` every key gets an id: there must be fewer keys than ids, and near that bound
    it takes many rounds. With one, keys may be any number, and those to which none of their
    attempts gave an id have no row.
    """
    pending = written(keys.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct(), "ids-pending")
    n, room = pending.count(), 16**digits
    if n > room and attempts is None:
        raise ValueError(f"{n} keys do not fit {room} ids")
    held, attempt = None, 0
    while n and attempt != attempts:
        digest = F.md5(F.concat(F.col("key").cast("string"), F.lit(f":{attempt}")))
        claims = pending.select("key", F.left(digest, F.lit(digits)).alias("id"))
        if held is not None:
            claims = claims.join(held.select("id"), "id", "left_anti")
        won = claims.groupBy("id").agg(F.min("key").alias("key")).select("key", "id", F.lit(attempt + 1).alias("attempts"))
        both = written(won if held is None else held.unionByName(won), "ids-held")
        left = written(pending.join(both.select("key"), "key", "left_anti"), "ids-pending")
        discard(pending)
        if held is not None:
            discard(held)
        held, pending, attempt = both, left, attempt + 1
        n = pending.count()
    if held is None:
        held = pending.select("key", F.lit("").alias("id"), F.lit(0).alias("attempts"))
    return held.withColumnRenamed("key", key)


def lockouts(failures: DataFrame, key: str, at: str, least: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS) -> DataFrame:
    """Failures (times in whole seconds) with those in the trailing span and whether they lock out.

    A failure that is exactly ``seconds`` old no longer counts.
    """
    span = Window.partitionBy(key).orderBy(at).rangeBetween(1 - seconds, 0)
    return failures.withColumn("n_recent", F.count(F.lit(1)).over(span)).withColumn("locked", F.col("n_recent") >= least)


def sign_ins(attempts: DataFrame, order: tuple[str, ...] = (), least: int = LOCKOUT_FAILURES, seconds: int = LOCKOUT_SECONDS, ttl: int = TTL_PENDING) -> DataFrame:
    """Outcome of attempts (key, at, ok, pending_at): locked, expired, refused or code, in that order.

    Only a refused attempt is a failure, and only a code clears the failures before it: what
    a lockout or an expired sign-in turns away changes nothing. A failure that is exactly
    ``seconds`` old no longer counts. ``order`` settles the order of attempts of the same time.
    """

    def step():
        failed: list = []  # times of at most ``least`` failures

        def answer(row: dict) -> str:
            failed[:] = [t for t in failed if t > row["at"] - seconds]
            if len(failed) >= least:
                return "locked"
            if row["pending_at"] is None or row["at"] - row["pending_at"] > ttl:
                return "expired"
            if not row["ok"]:
                failed.append(row["at"])
                return "refused"
            failed.clear()
            return "code"

        return answer

    return _folded(attempts, "key", ["at", *order], step, "outcome")


def code_exchanges(codes: DataFrame, uses: DataFrame) -> DataFrame:
    """(use_id, ok) for uses (use_id, code, client, at) of codes (code, client, at): single use, bound, in time."""
    rows = uses.join(codes.select("code", F.col("client").alias("owner"), F.col("at").alias("made_at")), "code", "left")
    good = (F.col("owner") == F.col("client")) & (F.col("at") - F.col("made_at") <= TTL_CODE)
    good = F.coalesce(good, F.lit(False))
    before = Window.partitionBy("code").orderBy("at", "use_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(good.cast("int")).over(before), F.lit(0)) == 1
    return rows.select("use_id", (good & ~used).alias("ok"))


def live_tokens(tokens: DataFrame, revoked: DataFrame, now: int) -> DataFrame:
    """Tokens (token, client, kind, at, replaced_by) that still count: not expired, rotated or revoked."""
    ttl = F.when(F.col("kind") == "refresh", F.lit(TTL_REFRESH)).otherwise(F.lit(TTL_ACCESS))
    fresh = tokens.filter((F.lit(now) - F.col("at") <= ttl) & F.col("replaced_by").isNull())
    return fresh.join(revoked.select("token"), "token", "left_anti")
