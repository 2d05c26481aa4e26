import random

import numpy as np

import corpus_pipeline as cp
from docsift.llm import near_copies as nc
from docsift.llm import simhash


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute_kept(rows, least=0.8):
    """Smallest id of each group (None where all are null)."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= least:
                label = [label[i] if x == label[j] else x for x in label]
    groups = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(doc_id)
    return sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=repr)


def planted(seed, n):
    """Texts, and copies of a similarity of 0.8 to 0.9."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(200, 400))]
        copy, own = list(words), plain_set(" ".join(words))
        while True:
            changed = list(copy)
            changed[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            if jaccard(own, plain_set(" ".join(changed))) < 0.8:
                break
            copy = changed
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    return rows


def test_stage_drops_copies_of_similarity_just_above_the_least(spark):
    rows = planted(3, 150)
    far = [(simhash.fingerprint(a[1]) ^ simhash.fingerprint(b[1])).bit_count() > 4 for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert sum(far) > 75  # op8's radius leaves most of them
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, "").collect())
    assert got == [r[0] for r in rows[::2]] == sorted(brute_kept(rows))


def test_stage_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for got in (cp.drop_near_copies(spark, docs, sf), nc.drop_near_copies(docs, most=3)):
        assert got.columns == docs.columns
        assert sorted((r.doc_id for r in got.collect()), key=repr) == brute_kept(rows)


def test_rows_are_told_apart_by_id_and_text(spark):
    long = " ".join(f"a{i}" for i in range(200))
    other = " ".join(f"b{i}" for i in range(200))
    rows = [(1, long), (1, other), (2, long + " end"), (3, other + " end"), (None, long + " stop"), (None, "alone"), (None, "alone"), (7, None), (8, " ")]
    got = nc.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, long), (1, other), (None, "alone"), (7, None)]))
    assert nc.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_extra_columns_may_clash(spark):
    names = "doc_id long, text string, digest string, stays string, id string, d string, whole string, own string, root string"
    text = " ".join(f"a{i}" for i in range(200))
    rows = [(1, text, *"abcdefg"), (2, text + " end", *"hijklmn"), (2, text + " end", *"hijklmn"), (3, "quite another", *"opqrstu")]
    got = nc.drop_near_copies(spark.createDataFrame(rows, names))
    assert got.columns == [n.split()[0] for n in names.split(", ")]
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[3]]


def test_large_group_around_one_text(spark):
    """Copies are alike to the original only, which all links pass; loose texts hang on single copies."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = [(500, " ".join(words))]
    for i in range(120):
        copy = list(words)
        for at in rng.sample(range(300), 6):
            copy[at] = f"n{i}x{at}"
        rows.append((1000 - i, " ".join(copy)))
        if i % 10 == 0:
            for at in rng.sample(range(300), 4):
                copy[at] = f"m{i}x{at}"
            rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    for most in (16, 512):
        assert sorted(r.doc_id for r in nc.drop_near_copies(docs, most=most).collect()) == want


def test_fingerprints_of_copies_are_near():
    rows = planted(8, 40)
    fps = [nc.fingerprint(nc.shingles(t.encode())) for _, t in rows]
    assert max((a ^ b).bit_count() for a, b in zip(fps[::2], fps[1::2], strict=True)) <= nc.RADIUS
    assert min((a ^ b).bit_count() for a, b in zip(fps[::2], fps[2::2], strict=False)) > nc.RADIUS


def test_similar_finds_links_across_sides():
    sets = [np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)]
    assert {frozenset(x) for x in nc.similar([5, 6, 7], sets, [1, 2, 3])} == {frozenset((5, 6)), frozenset((6, 7))}
    assert {frozenset(x) for x in nc.similar([5, 6, 7], sets, [1, 1, 3])} == {frozenset((6, 7))}
    assert {frozenset(x) for x in nc.similar([5, 6, 7], sets, [1, 2, 3], [0, 0, 1])} == {frozenset((6, 7))}
