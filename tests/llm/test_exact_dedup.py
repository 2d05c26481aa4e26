import random
import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from docsift.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, n_chars long, digest string"


def brute(rows):
    groups = defaultdict(list)
    for place, (doc_id, text, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, place, doc_id))
    out = []
    for text, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[4], best[4], len(members), m[3] == best[3], sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def rows_for(seed=1):
    rng = random.Random(seed)
    pool = ["", None, " ", "a b", "ab", "a\nb ", "é x", "é x", "z" * 5000, "long " * 3000]
    rows = [(i, rng.choice(pool), i, "clash") for i in range(300)]
    rows += [(7, "a b", 1, "again"), (7, "a b", 1, "again"), (None, "a  b", 2, None), (None, None, None, None)]
    rows += [(1000 + i, f"own {i}", i, "x") for i in range(200)]
    return rows


def test_decisions_match_brute_force(spark):
    rows = rows_for()
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    for phi, counters in ((1 / 1000, 4000), (0.05, 40), (0.3, 4)):
        got = ed.decisions(docs, phi, counters).collect()
        assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = rows_for(2)
    docs = spark.createDataFrame(rows, SCHEMA)
    for phi, counters in ((1 / 1000, 4000), (0.05, 40)):
        kept = ed.drop_copies(docs, phi, counters)
        assert kept.columns == docs.columns
        want = sorted(repr((m[0], m[4])) for m in (eval(x) for x in brute(rows)) if m[3])
        clean = kept.select("doc_id", F.sha2(ed.normalised(F.col("text")), 256).alias("s"))
        assert sorted(repr(tuple(r)) for r in clean.collect()) == want


def test_drop_copies_with_clashing_names(spark):
    names = "doc_id long, text string, key string, stays string, id string, whole string, digest string, rank string, w_rank string, chars string"
    rows = [(3, "a b c", *"12345678"), (1, "a  bc", *"abcdefgh"), (1, "a  bc", *"abcdefgh"), (9, "another", *"ijklmnop")]
    got = ed.drop_copies(spark.createDataFrame(rows, names))
    assert got.columns == [n.split()[0] for n in names.split(", ")]
    assert sorted(map(tuple, got.collect())) == [rows[1], rows[3]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ed.decisions(docs).count() == 0
    assert ed.drop_copies(docs).count() == 0


def test_misra_gries_bounds():
    rng = random.Random(3)
    stream = [rng.choice("aaaaaaabbbbcdefghijklmnop") for _ in range(2000)]
    counts: dict = {}
    for at in range(0, len(stream), 100):
        more = defaultdict(int)
        for x in stream[at : at + 100]:
            more[x] += 1
        counts = ed.misra_gries(counts, more, 4)
        assert len(counts) <= 4
    for x in set(stream):
        low = counts.get(x, 0)
        assert low <= stream.count(x) <= low + len(stream) / 5
