"""Literal addresses and what ranges they are in, by the longest prefix that matches.

An address is its family and two longs; a range its family, prefix length and the bits under
that prefix. Each address meets the ranges by an equi-join on (family, length, masked bits),
for each length that occurs among the ranges, and the longest match counts. How many ranges
there are makes no difference to how an address is looked up.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that are not public, and public ones inside them.
CLOSED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20",
    "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
OPEN = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
ADDRESS = "struct<family:int,high:long,low:long>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that stands in it often but is worked out, and written into the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _address(family: int, high: Column, low: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), high.cast("long").alias("high"), low.cast("long").alias("low"))


def _ipv4(name: Column) -> Column:
    """An IPv4 literal as a number, else null."""
    octets = F.transform(F.split(name, "[.]"), lambda x: F.when(x.rlike("^[0-9]{1,3}$"), x.try_cast("int")))
    value = lambda o: F.when((F.size(o) == 4) & F.forall(o, lambda x: F.coalesce(x <= 255, F.lit(False))), F.aggregate(o, F.lit(0).cast("long"), lambda n, x: n * 256 + x))
    return _let(octets, value)


def _ipv6(text: Column) -> Column:
    """An IPv6 literal of hexadecimal groups alone as an address, else null."""
    part = lambda halves, i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")

    def groups(x: Column) -> Column:
        missing = F.lit(8) - F.size(x["left"]) - F.size(x["right"])
        filled = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["right"])
        return F.when(x["n"] == 1, F.split(text, ":")).when((x["n"] == 2) & (missing >= 1), filled)

    def value(every: Column) -> Column:
        number = F.transform(every, lambda g: F.conv(g, 16, 10).cast("long"))
        half = lambda at: F.aggregate(F.slice(number, at, 4), F.lit(0).cast("long"), lambda n, x: F.shiftleft(n, 16).bitwiseOR(x))
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(F.coalesce(good, F.lit(False)) & ~text.rlike("^:[^:]|[^:]:$|:::"), F.struct(half(1).alias("high"), half(5).alias("low")))

    def judged(x: Column) -> Column:
        mapped = (x["high"] == 0) & (F.shiftrightunsigned(x["low"], 32) == 65535)
        return F.when(mapped, _address(4, F.lit(0), x["low"].bitwiseAND(0xFFFFFFFF))).when(x.isNotNull(), _address(6, x["high"], x["low"]))

    parts = lambda halves: F.struct(F.size(halves).alias("n"), part(halves, 0).alias("left"), part(halves, 1).alias("right"))
    return _let(_let(_let(_let(F.split(text, "::"), parts), groups), value), judged)


def parsed(name: Column) -> Column:
    """(family, high, low) of an IPv4 or IPv6 literal, else null. A zone is left out; IPv4 within IPv6 is IPv4.

    Anything with a colon that is no address is family 0, so that it is not taken for a name.
    """

    def hexed(x: Column) -> Column:
        """With an IPv4 tail as two groups."""
        tail = F.regexp_extract(x, "([^:]*)$", 1)
        two = lambda n: F.concat(F.left(x, F.length(x) - F.length(tail)), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(65535))))
        return F.when(tail.contains("."), F.coalesce(_let(_ipv4(tail), two), F.lit(":"))).otherwise(x)

    four = lambda n: F.when(n.isNotNull(), _address(4, F.lit(0), n))
    one = lambda x: F.when(x.contains(":"), F.coalesce(_let(hexed(x), _ipv6), _address(0, F.lit(0), F.lit(0)))).otherwise(_let(_ipv4(x), four))
    return _let(F.lower(F.regexp_replace(name, "%.*$", "")), one)


def _masked(address: Column, length: Column) -> tuple[Column, Column]:
    """The bits of an address under a prefix length, for either family."""
    ones = F.lit(-1).cast("long")
    keep = lambda bits: F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, ones).otherwise(F.call_function("shiftleft", ones, (F.lit(64) - bits).cast("int")))
    four = address["family"] == 4
    # the 32 bits of IPv4 are the last of the low half
    low = F.when(four, keep(length + 32)).otherwise(keep(length - 64))
    return F.when(four, F.lit(0).cast("long")).otherwise(address["high"].bitwiseAND(keep(length))), address["low"].bitwiseAND(low)


def ranges(table: DataFrame, column: str = "cidr") -> DataFrame:
    """``table`` with family, length, high and low of its ranges; rows that are none go. Bits beyond the prefix do not count."""
    address = parsed(F.substring_index(column, "/", 1))
    rows = table.withColumns({"address": address, "length": F.substring_index(column, "/", -1).try_cast("int")})
    fits = (F.col("address.family") > 0) & F.col("length").between(0, F.when(F.col("address.family") == 4, 32).otherwise(128))
    high, low = _masked(F.col("address"), F.col("length"))
    return rows.filter(F.coalesce(fits, F.lit(False))).select(*table.columns, F.col("address.family").alias("family"), "length", high.alias("high"), low.alias("low"))


def lengths_of(table: DataFrame) -> list[tuple[int, int]]:
    """(family, length) of what occurs in a table of ranges: 162 pairs at most."""
    return [tuple(r) for r in table.select("family", "length").distinct().collect()]


def policy(spark) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The ranges above, as of :func:`ranges` with a column ``closed``, and their lengths."""
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    rows = []
    for cidr, closed in [(x, True) for x in CLOSED] + [(x, False) for x in OPEN]:
        net = ipaddress.ip_network(cidr)
        bits = int(net.network_address)
        rows.append((cidr, closed, net.version, net.prefixlen, signed(bits >> 64), signed(bits & (1 << 64) - 1)))
    return spark.createDataFrame(rows, "cidr string, closed boolean, family int, length int, high long, low long"), sorted({(r[2], r[3]) for r in rows})


def longest_match(names: DataFrame, table: DataFrame, lengths: list[tuple[int, int]], value: str, column: str = "host") -> DataFrame:
    """(host, address, value): for each distinct name that is a literal address, ``value`` of the narrowest range it is in, or null.

    ``table`` is of :func:`ranges`, each range once, and ``lengths`` those that occur in it (:func:`lengths_of`).
    """
    own = names.select(F.col(column).alias("host")).distinct().withColumn("address", parsed(F.col("host"))).filter("address IS NOT NULL")
    of = lambda family: F.array(*[F.lit(n) for kind, n in lengths if kind == family]).cast("array<int>")
    each = own.select("host", "address", F.explode_outer(F.when(F.col("address.family") == 4, of(4)).when(F.col("address.family") == 6, of(6))).alias("length"))
    high, low = _masked(F.col("address"), F.col("length"))
    each = each.select("host", "address", F.col("address.family").alias("family"), "length", high.alias("high"), low.alias("low"))
    met = each.join(table.select("family", "length", "high", "low", F.struct(F.col(value).alias("v")).alias("found")), ["family", "length", "high", "low"], "left")
    best = F.max_by("found", F.when(F.col("found").isNotNull(), F.col("length")))
    return met.groupBy("host", "address").agg(best.alias("best")).select("host", "address", F.col("best.v").alias(value))


def closed_hosts(names: DataFrame, column: str = "host") -> DataFrame:
    """(host) of the distinct names that are literal addresses outside the public ranges, or not well formed."""
    found = longest_match(names, *policy(names.sparkSession), "closed", column)
    return found.filter(F.col("closed") | (F.col("address.family") == 0)).select("host")
