import math
import random
from collections import Counter

import pytest

from docsift.llm import language_model as lm


def brute(rows):
    texts = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "") for _, t, *_ in rows]
    import re

    docs = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    words, pairs = Counter(), Counter()
    for d in docs:
        words.update(d)
        pairs.update(zip(d, d[1:], strict=False))
    everything = sum(words.values())
    out = []
    for (doc_id, *_), d in zip(rows, docs, strict=True):
        own_w, own_p = Counter(d), Counter(zip(d, d[1:], strict=False))
        others = max(everything - len(d), 1)
        score = backoff = 0
        for i, w in enumerate(d):
            pair = (d[i - 1], w)
            if i and pairs[pair] > own_p[pair]:
                score += math.log((pairs[pair] - own_p[pair]) / (words[d[i - 1]] - own_w[d[i - 1]]))
                continue
            if i:
                backoff += 1
                score += math.log(0.4)
            left = words[w] - own_w[w]
            score += math.log(left / others) if left else math.log(0.4 / others)
        out.append((doc_id, len(d), backoff, score, math.exp(-score / len(d)) if d else None))
    return out


def same(df, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[3], 4))
    got = sorted(map(tuple, df.select("doc_id", "n_tokens", "n_backoff", "log_score", "perplexity").collect()), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)
        assert (g[4] is None) == (w[4] is None) and (g[4] is None or g[4] == pytest.approx(w[4], rel=1e-9))


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    same(lm.score(docs), want)
    same(lm.score(docs, block_bytes=20_000, bucket_bytes=5_000), want)


def test_edge_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the of a B cé d".split()) for _ in range(rng.randrange(30))), "x") for i in range(80)]
    rows += [(None, None, "x"), (None, " \n", "y"), (5, "the", "x"), (5, "the", "x"), (900, "of a " * 50_000, "x"), (901, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(3)
    same(lm.score(docs, block_bytes=300, bucket_bytes=200), brute(rows))
    same(lm.score(docs.filter("doc_id = 901")), brute([r for r in rows if r[0] == 901]))
    assert lm.score(docs.limit(0)).count() == 0
