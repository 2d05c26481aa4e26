import random

import numpy as np
import xxhash

from docsift.llm import simhash as sh
from docsift.llm.components import components


def plain_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(repr((rows[i][0], fps[i], least.get(find(i)))) for i in range(len(rows)))


def as_rows(df):
    return sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in df.collect())


def test_groups_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert as_rows(sh.groups(docs)) == brute_groups(rows)


def test_groups_with_edge_rows(spark):
    rng = random.Random(5)
    base = [rng.choice("alpha beta gamma delta éps zeta eta THETA".split()) + str(rng.randrange(40)) for _ in range(900)]
    rows = [(1, None), (2, ""), (None, " \t"), (3, "one"), (4, "one two three"), (4, "one two three"), (5, "ONE two\nthree")]
    for i in range(60):  # a chain of near copies
        base[rng.randrange(900)] = f"new{i}"
        rows.append((100 - i, " ".join(base)))
    rows += [(None, "lonely " * 3), (200, "x" * 200_000), (201, "w " * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_rows(sh.groups(docs)) == brute_groups(rows)
    assert as_rows(sh.groups(docs, most=4)) == brute_groups(rows)


def test_drop_near_copies(spark):
    rows = [(3, "a b c d e", "x"), (1, "A b c d e", "y"), (1, "A b c d e", "y"), (None, "a b c d e", "n"), (9, "quite another text here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sh.drop_near_copies(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4]]))
    empty = spark.createDataFrame([], docs.schema)
    assert sh.groups(empty).count() == 0
    assert sh.drop_near_copies(empty).count() == 0


def test_drop_near_copies_with_clashing_names(spark):
    names = "doc_id long, text string, stays string, again string, id string, whole string, own_id string"
    for again in (0, 1):
        rows = [(3, "a b c d e", *"12345"), (1, "A b c d e", *"abcde"), (9, "quite another text here", *"vwxyz")]
        got = sh.drop_near_copies(spark.createDataFrame(rows + rows[1:2] * again, names))
        assert sorted(map(tuple, got.collect())) == rows[1:]


def test_tree_finds_what_brute_force_finds():
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (1 << 64) - 1 for _ in range(400)})
    tree = sh.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7] + [rng.getrandbits(64)]:
        assert sorted(tree.within(q, 4)) == [v for v in values if (q ^ v).bit_count() <= 4]


def test_blocks_cover_all_bits():
    for radius in range(5):
        assert sorted(b for s, w in sh.blocks(radius) for b in range(s, s + w)) == list(range(64))


def test_components_of_a_path_and_a_star(spark):
    rng = np.random.default_rng(1)
    path = [(int(a), int(a) + 1) for a in rng.permutation(300)]
    star = [(5000, int(x)) for x in range(6000, 6500)] + [(-4, -4), (-3, -9)]
    got = dict(map(tuple, components(spark.createDataFrame(path + star, "u long, v long")).collect()))
    want = {n: 0 for n in range(301)} | {n: 5000 for n in [5000, *range(6000, 6500)]} | {-3: -9, -9: -9}
    assert got == want
