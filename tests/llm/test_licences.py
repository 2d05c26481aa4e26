import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import licences as lc


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_base(text):
    words = plain_words(text)
    places = []
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [a for a, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base_of(row):
    return row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    got = lc.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert base_of(r) == plain_base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "The MIT-License; mit LICENSE\x00mit license2 Éapache license", None), (3, "mit license " * 40_000, "x"), (3, "mit license " * 40_000, "x")]
    got = lc.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    for r, (doc_id, text, _) in zip(got, rows, strict=True):
        assert r.doc_id == doc_id and base_of(r) == plain_base(text)
    assert got[0].score == 0 and got[0].labels == "" and got[0].first_word is None
    assert lc.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="miT lceNsaphgu-\nÉ0", max_size=80))
def test_words_and_phrases(text):
    assert base_of(lc.scanner().scan(text.encode())) == plain_base(text)


def test_matching_statistics_against_brute_force():
    rng = random.Random(1)
    templates = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    sam = lc.SuffixAutomaton()
    for t, symbols in enumerate(templates):
        sam.add(t, symbols)
    sam.finish(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(100):
        text = [rng.randrange(0, 5) for _ in range(40)]
        longest = [max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in runs), default=0) for i in range(len(text))]
        want = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= 3 and (i + 1 == len(text) or longest[i + 1] <= n)]
        got = sam.matches(text, 3)
        assert [(a, b) for a, b, _ in got] == want
        for a, b, state in got:
            ends = {(t, e) for t, es in sam.ends[state].items() for e in es}
            assert ends == {(t, i + b - a - 1) for t, s in enumerate(templates) for i in range(len(s)) if s[i : i + b - a] == text[a:b]}


def test_templates_are_found_with_small_changes():
    one = lc.scanner()
    for name, text in lc.TEMPLATES.items():
        found = one.scan(f"Some words before. {text} and after".encode())
        assert name in found["labels"].split(",") and found["score"] == 1
        span = next(x for x in found["spans"] if x["template"] == name)
        assert (span["first"], span["stop"]) == (3, 3 + len(plain_words(text)))
        words = text.split()
        if len(words) > 30:
            words[len(words) // 2] = "CHANGED"
            assert name in one.scan(" ".join(words).encode())["labels"].split(",")
            assert name not in one.scan(" ".join(words[: len(words) // 2]).encode())["labels"].split(",")
    assert one.scan(b"permission is hereby granted to the free software of this program")["labels"] == ""


def test_kindred_wordings_are_told_apart():
    one = lc.scanner()
    for name, text in lc.TEMPLATES.items():
        labels = {x["template"] for x in one.scan(f"{text} {text}".encode())["spans"]}
        assert labels - {"apache-2.0-notice"} <= {name}, (name, labels)
    both = one.scan(f"{lc.TEMPLATES['gpl-text']} And: {lc.TEMPLATES['agpl-3.0-text']}".encode())
    assert [x["template"] for x in both["spans"]] == ["gpl-text", "agpl-3.0-text"]


def test_settled_spans_against_brute_force():
    rng = random.Random(4)
    one = lc.scanner()
    size = [len(s) for s in one.sequences]
    for _ in range(200):
        spans = []
        for _ in range(rng.randrange(12)):
            a = rng.randrange(60)
            spans.append((rng.choice(one.names), a, a + rng.randrange(1, 40), rng.choice([0.8, 0.9, 1.0])))
        spans.sort(key=lambda x: (x[1], x[2], x[0]))
        force = [(round(c * size[one.index[n]]), c) for n, _, _, c in spans]
        shared = lambda x, y: min(x[2], y[2]) - max(x[1], y[1])
        want = [x for x, f in zip(spans, force, strict=True) if not any(g > f and 2 * shared(x, y) >= x[2] - x[1] for y, g in zip(spans, force, strict=True))]
        assert one._settled(spans) == want


def test_score_grades_the_evidence():
    score = lambda text: lc.scanner().scan(text.encode())["score"]
    assert score("nothing of the kind") == 0
    assert score("they spoke of the MIT license") == lc.MENTION
    assert score(lc.TEMPLATES["zlib-text"]) == 1
    words = lc.TEMPLATES["zlib-text"].split()
    assert 0.8 <= score(" ".join(words[:-6])) < 1


def test_plain_prose_has_no_labels():
    rng = np.random.default_rng(2)
    words = [w.decode() for w in lc.scanner().ids]
    text = " ".join(rng.choice(words, 5000))
    assert lc.scanner().scan(text.encode())["labels"].replace("mit", "").strip(",") in ("", "gpl", "apache")
