import hashlib

import numpy as np

from docsift.llm import sketches as sk


def neighbours(rows):
    """Text next to each row by descending id, after the last the first."""
    placed = sorted((i for i, r in enumerate(rows) if r[0] is not None), key=lambda i: -rows[i][0])
    out = {i: "" for i, r in enumerate(rows) if r[0] is None}
    for a, b in zip(placed, placed[1:] + placed[:1], strict=True):
        out[a] = rows[b][1] or ""
    return out


def want(rows):
    following, out = neighbours(rows), []
    for i, (doc_id, text, *_) in enumerate(rows):
        text = text or ""
        changed = sk.edited(text, following[i])
        own, other, near = sk._of([text, changed, following[i]])
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), sk.to_text(own), sk.to_text(other), sk.likeness(own, other), sk.likeness(own, near)))
    return sorted(map(repr, out))


def got(df):
    assert df.columns == sk.OUT
    return sorted(repr(tuple(r)) for r in df.collect())


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(sk.with_next(docs.repartition(5))) == want(rows)
    assert got(sk.with_next(docs, ranges=1)) == want(rows)


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(sk, "STEP", 500)
    rows = [(i * 3, ["", None, "é", "one two", "a b c d e f g " * (i % 9), "日本 " * 40, "x" * 3000][i % 7], "c") for i in range(120)]
    rows += [(None, "no id at all here", "c"), (None, None, "c"), (-5, "word " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)
    for ranges in (1, 2, 40):
        assert got(sk.with_next(docs, ranges)) == want(rows)
    one = docs.filter("doc_id = 6")
    assert got(sk.with_next(one)) == want([r for r in rows if r[0] == 6])
    assert sk.with_next(docs.limit(0)).count() == 0
    again = docs.filter("doc_id = 9").union(docs.filter("doc_id = 9")).union(docs.filter("doc_id = 12"))
    assert sk.with_next(again).count() == 3


def test_hashes_by_words_not_by_place():
    a, b, c, d = sk._of(["The quick brown fox jumps over", "\n the  QUICK brown fox\tjumps over ", "over jumps fox brown quick the", "over"])
    assert a.tolist() == b.tolist()
    assert a.tolist() != c.tolist() and len(d) == 1


def test_estimates_and_merging():
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 6000)]
    whole, half, part = sk._of([" ".join(words), " ".join(words[:3000]), " ".join(words[1000:1300])])
    assert abs(len(whole) / 5996 - sk.SHARE) < 0.03
    assert abs(sk.likeness(whole, half) - 0.5) < 0.05
    assert sk.containment(part, whole) == 1.0 and sk.containment(half, whole) > 0.99
    assert abs(sk.containment(whole, part) - 0.05) < 0.02
    other = sk._of([" ".join(words[2996:])])[0]
    assert sk.likeness(sk.merged(half, other), whole) == 1.0
    assert sk.from_text(sk.to_text(whole)).tolist() == whole.tolist()
