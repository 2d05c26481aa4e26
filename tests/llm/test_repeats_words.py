import random
import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from docsift.llm import queries
from docsift.llm import repeats as rp
from tests.llm.test_repeats import brute, mixture

SF = "/root/testdata/sf0.01"


def brute_left(rows, width):
    """(doc_id, what is left without blanks, words that went) after each word in a repeated window of words went."""
    found = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\f]+", (t or "").encode())] for _, t in rows]
    texts = [[t.encode()[a:b] for a, b in f] if t else [] for (_, t), f in zip(rows, found, strict=True)]
    seen = Counter(tuple(w[s : s + width]) for w in texts for s in range(len(w) - width + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts, strict=True):
        gone = set()
        for s in range(len(words) - width + 1):
            if seen[tuple(words[s : s + width])] > 1:
                gone |= set(range(s, s + width))
        out.append((doc_id, [w.decode() for i, w in enumerate(words) if i not in gone], len(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "width", "gram"), [(1, 8, 3), (2, 12, 5), (3, 51, 16)])
def test_word_windows_match_brute_force(spark, seed, width, gram):
    rows = mixture(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rp.drop_repeats(docs, width, gram, words=True).collect()
    assert sorted(repr((r.doc_id, (r.text or "").split())) for r in got) == sorted(repr(x[:2]) for x in brute_left(rows, width))


@pytest.mark.parametrize(("seed", "sizes"), [(4, ((40, 20), (9, 3))), (5, ((100, 7), (20, 8)))])
def test_two_kinds_in_one_search_match_brute_force(spark, seed, sizes):
    rows = mixture(seed)
    (width, gram), (count, word_gram) = sizes
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = rp.removals(docs, width, gram, more=(rp.Windows(count, word_gram, words=True),)).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in found) == brute(rows, width)
    assert sorted(repr((r.doc_id, r.covered[1])) for r in found) == sorted(repr((i, n)) for i, _, n in brute_left(rows, count))
    assert all(r.covered[0] == r.n_removed for r in found)


def test_query_counts_passage_words(spark):
    docs = f"{SF}/documents.parquet"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(docs).select("doc_id", "text").collect()]
    got = [(r.doc_id, r.passage_words) for r in queries.op4_repeated_passages(spark, SF).collect()]
    assert sorted(got) == sorted((i, n) for i, _, n in brute_left(rows, 51))
    assert sum(n > 0 for _, n in got) > 5


@pytest.mark.parametrize("letters", [1, 3, 6])
def test_stage_cuts_a_passage_of_51_words_and_leaves_one_of_50(spark, letters):
    rng = random.Random(letters)
    own = lambda k: " ".join(f"own{rng.randrange(10**9)}" for _ in range(k))
    say = lambda k: " ".join("".join(rng.choice("abcdefghij") for _ in range(letters)) for _ in range(k))
    long, short, unbroken = say(51), say(50), "".join(rng.choice("abc") for _ in range(450))
    assert len(long) < 400
    rows = [(i, f"{own(80)} {long}\n{own(90)} {short} {own(70)} {unbroken} {own(5)}") for i in range(2)]
    got = cp.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    for r in got:
        assert long not in r.text and short in r.text and unbroken not in r.text
        assert len(re.findall("own", r.text)) >= 244  # the 450 letters have the blank and "own" behind them in common too
