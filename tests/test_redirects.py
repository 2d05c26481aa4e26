import random
from urllib.parse import urljoin

from docsift.operators import redirects

ANSWER = "url string, status int, location string"


def test_relative_references_as_the_rules_have_them(spark):
    bases = ["https://a.example/x/y", "https://a.example", "https://a.example/x/?q=1#f", "https://a.example/x/y?q", "https://a.example/b/c/d;p?q"]
    places = ["../z", "z", "./z", "/z/../w", "?n=1", "#f", "//b.example/q", "http://c.example/", "../../../z", "z/./y/..", "..", ".", "", "z?x=../y", "g;x=1/../y", "/", "/a//b", "mailto:x", "../z#f/../g"]
    rows = spark.createDataFrame([(b, p) for b in bases for p in places], "b string, p string")
    got = {(r.b, r.p): r.u for r in rows.select("b", "p", redirects.joined(rows.b, rows.p).alias("u")).collect()}
    want = {(b, p): urljoin(b, p) for b in bases for p in places}
    want |= {(b, ""): b.split("#")[0] for b in bases}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {}


def brute(url, answers, closed, hops=3):
    trail, now = [], url
    for hop in range(hops + 1):
        if not (now or "").startswith("https://") or closed in now:
            return None, hop, "policy", trail
        asked = now.split("#")[0]
        trail.append(asked)
        if asked not in answers:
            return None, hop, "unreachable", trail
        status, location = min(answers[asked], key=lambda a: (a[0], a[1] is not None, a[1] or ""))
        if status not in redirects.REDIRECTS:
            return (now, hop, "ok", trail) if 200 <= status < 300 else (None, hop, "http", trail)
        if not (location or "").strip():
            return None, hop, "no location", trail
        now = urljoin(now, location)
        if now.split("#")[0] in trail:
            return None, hop, "loop", trail
    return None, hops, "too many redirects", trail


def test_equals_following_one_by_one(spark):
    rng = random.Random(2)
    urls = [f"https://h{i}.example/p/{i}" for i in range(60)]
    made = []
    for i, u in enumerate(urls):
        where = rng.choice([urls[(i + 1) % 60], rng.choice(urls), f"/p/{i}#x", "../p/" + str(i), None, " ", "https://10.0.0.7/", "http://x.example/", f"//h{(i + 7) % 60}.example/p/{(i + 7) % 60}#frag"])
        made.append((rng.choice([u, u + "#ignored"]), rng.choice([200, 301, 302, 303, 307, 308, 302, 404, 204]), where))
    made += [(urls[3], 302, urls[4]), (urls[3], 302, urls[4])]
    answers = {}
    for u, status, where in made:
        answers.setdefault(u.split("#")[0], []).append((status, where))
    asks = [(i, u) for i, u in enumerate(urls)] + [(100, urls[0] + "#top"), (101, "http://h1.example/p/1"), (102, None), (103, ""), (104, "https://nobody.example/"), (7, urls[8])]
    for hops in (3, 1, 0, 6):
        found = redirects.follow(spark.createDataFrame([(*a, "x") for a in asks], "id int, url string, status string"), spark.createDataFrame(made, ANSWER), hops)
        got = sorted(map(repr, [(r.id, r.url, r.final_url, r.hops, r.outcome, r.trail) for r in found.collect()]))
        assert got == sorted(map(repr, [(i, u, *brute(u, answers, "10.0.0.7", hops)) for i, u in asks]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], ANSWER)
    one = spark.createDataFrame([(1, "https://a.example/")], "id int, url string")
    assert [r.outcome for r in redirects.follow(one, none).collect()] == ["unreachable"]
    assert redirects.follow(one.limit(0), none).count() == 0
