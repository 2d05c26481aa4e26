import random
import re
from collections import defaultdict
from hashlib import sha256

from docsift.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, width=10):
    listed = defaultdict(set)
    for item_id, text, *_ in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            listed[tuple(w[k : k + width])].add(item_id)
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in listed}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in listed:
                    hit.update(range(k, k + size))
                    found |= listed[x] - {None}
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def got(df):
    assert df.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted(repr(tuple(r)) for r in df.collect())


def tables(seed, vocabulary=12):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(["The", "of", "É", "é", "x1", "ñandú", "no", "Über", "a", "b", "c9", "z"][:vocabulary]) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "... \n"), (None, say(12)), (3, say(14)), (3, items[3][1]), (200, items[5][1])]
    docs = [(i, say(rng.randrange(60))) for i in range(150)]
    for i in range(60):
        text = rng.choice(items)[1] or ""
        cut = text.split(" ")
        a = rng.randrange(len(cut))
        docs.append((1000 + i, f"{say(4)}, {' - '.join(cut[a:]).upper()}! {say(3)}"))
    docs += [(5, None), (None, "x"), (None, items[0][1]), (7, ""), (7, "  \x00"), (8, items[7][1]), (8, items[7][1]), (8, "other " + items[7][1]), (9, (say(40) + " ") * 300)]
    return docs, items


def test_equals_brute_force(spark):
    for seed, width, shingle, block in ((1, 10, 3, 1 << 20), (2, 10, 3, 3), (3, 4, 2, 1 << 20), (4, 1, 3, 7)):
        docs, items = tables(seed)
        mine = spark.createDataFrame([(*d, "item", 1) for d in docs], "doc_id long, text string, item_id string, window int").repartition(5)
        theirs = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id int")
        assert got(dc.decontaminate(mine, theirs, width, shingle, block)) == brute(docs, items, width)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = sha256(b"").hexdigest()
    assert got(dc.decontaminate(docs, items.limit(0))) == sorted(map(repr, [(1, 2, 0, 0, none, False), (2, 0, 0, 0, none, False)]))
    assert got(dc.decontaminate(docs.limit(0), items)) == []


def test_occurrences_say_where(spark):
    docs = spark.createDataFrame([(1, "x y One two three four five six seven eight nine ten eleven z")], "doc_id long, text string")
    items = spark.createDataFrame([(4, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    places, listed = dc.occurrences(docs, items)
    assert sorted((r.start, r.length) for r in places.collect()) == [(2, 10), (3, 10)]
    assert {r.window for r in places.collect()} == {r.window for r in listed.collect()}


def test_no_python_in_any_plan(spark):
    docs, items = tables(5)
    df = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowScan", "")
