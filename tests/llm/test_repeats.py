import hashlib
import random
from collections import Counter

import pytest

from docsift.llm import repeats as rp


def brute(rows, width):
    seen = Counter()
    texts = [(t or "").encode() for _, t, *_ in rows]
    for data in texts:
        for s in range(len(data) - width + 1):
            seen[data[s : s + width]] += 1
    out = []
    for (doc_id, *_), data in zip(rows, texts, strict=True):
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            if seen[data[s : s + width]] > 1:
                gone[s : s + width] = b"\x01" * width
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def mixture(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "日本", "delta", "x", "of", "the"]
    say = lambda k: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(k))
    passages = [say(k) for k in (9, 12, 20, 60)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else say(rng.randrange(1, 40)))
        rows.append((i, " ".join(parts)))
    for i in range(15):  # near copies with single edits
        text = list(rows[rng.randrange(n)][1])
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = "#"
        rows.append((n + i, "".join(text)))
    rows += [(900, None), (901, ""), (None, "Ha " * 200), (902, "a" * 500), (903, "ab" * 300 + "c"), (904, "short")]
    rows += [(905, rows[0][1] * 2), (905, rows[0][1] * 2), (None, passages[3]), (906, passages[3]), (907, "ab" * 40)]
    return rows


@pytest.mark.parametrize(("seed", "width", "gram"), [(1, 40, 20), (2, 60, 45), (3, 100, 7)])
def test_removals_match_brute_force(spark, seed, width, gram):
    rows = mixture(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(rp.removals(docs, width, gram)) == brute(rows, width)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(rp.removals(docs)) == brute(rows, 400)


def test_drop_repeats_keeps_columns_and_rows(spark):
    rows = [(i, t, "src", None if t is None else len(t)) for i, t in mixture(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_chars long")
    out = rp.drop_repeats(docs, 40, 20)
    assert out.columns == docs.columns
    want = {r[0]: r for r in (eval(x) for x in brute([r[:2] for r in rows], 40)) if r[0] is not None}
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.text is not None:
            assert r.n_chars == len(r.text)
            if want[r.doc_id][2] == 0:
                assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][4]
    assert any(r.text == "" for r in found)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert rp.removals(docs).count() == 0
    assert rp.drop_repeats(docs).count() == 0


def test_long_text_in_segments(monkeypatch):
    import numpy as np

    rng = random.Random(9)
    data = np.frombuffer("".join(rng.choice("abc") for _ in range(5000)).encode(), np.uint8)
    monkeypatch.setattr(rp, "SEGMENT", 700)
    core, hull, place, s1, s2, n, *_ = rp.pieces_of(data, 50, 20)
    starts = sorted(s for a, b in zip(s1, s2, strict=True) for s in range(a, b + 1))
    assert starts == list(range(4951))


@pytest.mark.parametrize("run", [rp.removals, rp.drop_repeats])
def test_steps_run_in_bounded_batches_without_shuffle_files_left_and_settings_stay(spark, monkeypatch, run):
    records, size, clean = (f"spark.sql.{x}" for x in ("execution.arrow.maxRecordsPerBatch", "execution.arrow.maxBytesPerBatch", "classic.shuffleDependency.fileCleanup.enabled"))
    before = spark.conf.get(records)
    try:
        spark.conf.set(records, "10000")
        had, seen, write = (spark.conf.get(size), spark.conf.get(clean)), [], rp.written
        monkeypatch.setattr(rp, "written", lambda df, tag: seen.append((int(spark.conf.get(records)), spark.conf.get(clean))) or write(df, tag))
        out = run(spark.createDataFrame(mixture(6), "doc_id long, text string"), 40, 20)
        assert seen and all(0 < n <= 256 and gone == "true" for n, gone in seen)
        assert "InArrow" not in out._jdf.queryExecution().toString()  # nothing of it runs later, under other settings
        assert (spark.conf.get(records), spark.conf.get(size), spark.conf.get(clean)) == ("10000", *had)
    finally:
        spark.conf.set(records, before)
