import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from tests.llm.test_near_copies import brute_kept
from tests.llm.test_packing import ids_of, one_by_one


@pytest.fixture(scope="module")
def stages(spark):
    """Rows in and out of each stage at sf0.01."""
    from docsift.scratch import written

    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), "test"))
    return out


def test_columns(stages):
    for df in stages[:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_keeps_what_labels_call_good(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    assert good <= kept
    assert len(bad & kept) <= 0.1 * len(bad)
    assert sorted(map(tuple, stages[1].collect())) == sorted(tuple(r) for r in stages[0].collect() if r.doc_id in kept)


def test_exact_dedup(stages):
    groups = defaultdict(list)
    for r in stages[1].collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert sorted(min(g)[1] for g in groups.values()) == sorted(r.doc_id for r in stages[2].collect())


def test_near_dedup(stages):
    """One document of each group of 5-word Jaccard similarity 0.8 or more stays, by brute force."""
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = brute_kept(rows)
    assert want == sorted((r.doc_id for r in stages[3].collect()), key=repr)
    assert len(want) < len(rows)


def covered(rows):
    """For each row the bytes that a repeated string of 400 bytes or of 51 words covers.

    Blanks between two words that go, go too.
    """
    texts = [(t or "").encode() for _, t in rows]
    found = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", t)] for t in texts]
    seen = Counter(t[s : s + 400] for t in texts for s in range(len(t) - 399))
    runs = [[t[a:b] for a, b in f] for t, f in zip(texts, found, strict=True)]
    said = Counter(tuple(w[s : s + 51]) for w in runs for s in range(len(w) - 50))
    out = []
    for t, f, w in zip(texts, found, runs, strict=True):
        gone = bytearray(len(t))
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                gone[s : s + 400] = b"\x01" * 400
        hit = {i for s in range(len(w) - 50) if said[tuple(w[s : s + 51])] > 1 for i in range(s, s + 51)}
        for i in hit:
            stop = f[i + 1][0] if i + 1 in hit else f[i][1]
            gone[f[i][0] : stop] = b"\x01" * (stop - f[i][0])
        out.append(gone)
    return out


def test_repeats(stages):
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    want = dict(zip((i for i, _ in rows), covered(rows), strict=True))
    before = {r.doc_id: r for r in stages[3].collect()}
    after = stages[4].collect()
    assert len(after) == len(rows)
    assert any(map(any, want.values()))
    for r in after:
        gone, text = want[r.doc_id], before[r.doc_id].text
        if not any(gone):
            assert r == before[r.doc_id]
        else:
            left = bytes(x for x, g in zip(text.encode(), gone, strict=True) if not g)
            assert r.text == left.decode("utf-8", "ignore")
            assert r.n_chars == len(r.text)


def test_packing(stages):
    want = Counter()
    for r in stages[4].collect():
        n = len(ids_of(r.text))
        for piece, start in enumerate(range(0, n, 4096)):
            want[r.doc_id, piece, start, min(4096, n - start)] += 1
    got = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert len({r.sequence_id for r in got}) == len(one_by_one([r.length for r in got], 4096))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
