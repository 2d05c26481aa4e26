import ipaddress
import random

from docsift.sources import addresses as ad


def literals(seed, n=400):
    rng = random.Random(seed)
    nets = [ipaddress.ip_network(x) for x in (*ad.CLOSED, *ad.OPEN)]
    out = []
    for _ in range(n):
        net = rng.choice(nets)
        number = int(net[0]) + rng.randrange(net.num_addresses) if rng.random() < 0.7 else rng.getrandbits(net.max_prefixlen)
        ip = ipaddress.IPv4Address(number) if net.version == 4 else ipaddress.IPv6Address(number)
        out.append(rng.choice([str(ip), ip.exploded, str(ip).upper()]))
    out += [str(x) for net in nets for x in (net[0], net[-1])]
    return [*out, "::ffff:10.0.0.1", "::ffff:8.8.8.8", "64:ff9b::10.1.2.3", "::", "::1", "1::", "fe80::1%eth0"]


def want(name):
    ip = ipaddress.ip_address(name.split("%")[0])
    ip = getattr(ip, "ipv4_mapped", None) or ip
    nets = [(ipaddress.ip_network(x), x in ad.CLOSED) for x in (*ad.CLOSED, *ad.OPEN)]
    found = [(n.prefixlen, closed) for n, closed in nets if n.version == ip.version and ip in n]
    return ip, max(found)[1] if found else None


def test_literals_of_both_families(spark):
    names = literals(1)
    rows = spark.createDataFrame([(x, 1) for x in names], "host string, address int")
    got = {r.host: (r.address.family, (r.address.high % 2**64 << 64) + r.address.low % 2**64, r.closed) for r in ad.longest_match(rows, *ad.policy(spark), "closed").collect()}
    assert got == {x: (ip.version, int(ip), closed) for x in names for ip, closed in [want(x)]}
    shut = {r.host for r in ad.closed_hosts(rows).collect()}
    assert shut == {x for x in names if want(x)[1]}
    mine = lambda ip: ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    further = [ipaddress.ip_network(x) for x in ("100.64.0.0/10", "3fff::/20")]  # shared and documentation, which the library takes for public
    differ = {x for x in names for ip in [want(x)[0]] if mine(ip) != (x in shut) and not any(ip.version == n.version and ip in n for n in further)}
    assert not differ


def test_names_and_what_only_looks_like_an_address(spark):
    names = ["a.example", "", "256.1.1.1", "1.2.3", "1.2.3.4.5", "1.2.3.x", None, "1:2:3", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "g::1", "12345::", "::1.2.3", "1:2:3:4:5:6:7:8:9", ":::", "1:2:3:4:5:6:7::8"]
    rows = spark.createDataFrame([(x,) for x in names], "host string")
    got = {r.host: r.a and r.a.family for r in rows.select("host", ad.parsed(rows.host).alias("a")).collect()}
    assert got == {x: 0 if x and ":" in x else None for x in names}
    assert {r.host for r in ad.closed_hosts(rows).collect()} == {x for x in names if x and ":" in x}


def test_any_table_of_ranges(spark):
    table = spark.createDataFrame([("10.0.0.0/8", "wide"), ("10.1.2.3/16", "narrow"), ("0.0.0.0/0", "all"), ("2001:db8::/33", "half"), ("2001:db8::5/128", "one"), ("nonsense", "x"), ("10.0.0.0/33", "x"), ("10.0.0.0", "x")], "cidr string, label string")
    ranges = ad.ranges(table)
    assert ranges.count() == 5
    rows = spark.createDataFrame([(x,) for x in ("10.9.9.9", "10.1.200.1", "11.0.0.1", "2001:db8::5", "2001:db8::6", "2001:db8:8000::", "2001:db8:7fff::1")], "host string")
    got = {r.host: r.label for r in ad.longest_match(rows, ranges, ad.lengths_of(ranges), "label").collect()}
    assert got == {"10.9.9.9": "wide", "10.1.200.1": "narrow", "11.0.0.1": "all", "2001:db8::5": "one", "2001:db8::6": "half", "2001:db8:8000::": None, "2001:db8:7fff::1": "half"}


def test_no_python_in_the_policy(spark):
    from docsift.sources import inputs

    rows = inputs.url_policy(spark.createDataFrame([("https://[::1]/",), ("https://u@10.0.0.1:8/x",), ("https://a.example",)], "url string"), "url")
    assert [r.url_error for r in rows.collect()] == ["non-public address", "non-public address", None] and "Python" not in rows._jdf.queryExecution().toString()
