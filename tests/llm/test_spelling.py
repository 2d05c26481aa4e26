import random
import re
from collections import Counter, defaultdict
from zlib import crc32

from docsift.llm import spelling as sp

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(docs, one_in=97, letters=5, least=3):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= letters and k >= least}


def brute(n, times=2):
    near = defaultdict(list)
    for a in n:
        near[a] = [b for b in n if apart(a, b)]
    best = {a: min(near[a], key=lambda b: (-n[b], b)) for a in n if near[a]}
    form = {a: b for a, b in best.items() if n[b] >= times * n[a]}

    def root(a):
        return root(form[a]) if a in form else a

    return sorted(map(repr, [(a, form.get(a), root(a), n[a], len(near[a]), n.get(form.get(a))) for a in n]))


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(repr(tuple(r)) for r in df.collect())


def documents(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(4, 8))) for _ in range(60)] + ["aaaaaa", "aaaaa", "aaabaa", "ÿÿÿÿÿ", "Élan", "flußbett"]
    docs = []
    for i in range(300):
        text = " ".join(rng.choice(base) for _ in range(rng.randrange(40)))
        docs.append((i, rng.choice([text, text.upper(), text.replace(" ", "-"), text.replace(" ", "1")])))
    long = "".join(rng.choice("xyz") for _ in range(63))
    for w in (long, long + "q", long + "qr", long + "qs", "p" + long + "qr", long * 40, long * 40 + "m", "m" + long * 40 + "m"):
        docs += [(900, w)] * 4
    docs += [(901, long + "qr")] * 9
    return [*docs, (5, None), (None, "abcde abcde fghij"), (None, None), (6, ""), (6, "× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ 12345 ñ")]


def test_vocabulary_and_variants_equal_brute_force(spark):
    for seed, one_in in ((1, 97), (2, 3)):
        rows = documents(seed)
        docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
        words = sp.vocabulary(docs, one_in=one_in)
        want = brute_words(rows, one_in)
        assert {r.word: r.n for r in words.collect()} == want
        for long in (sp.LONG, 5, 1):
            assert got(sp.variants(words, long=long)) == brute(want)


def test_chains_lead_to_one_root_and_ties_to_the_smallest(spark):
    n = {"abcdefgh": 200, "abcdefg": 90, "abcdef": 40, "abcde": 20, "abcd": 8, "abc": 3, "tiexa": 9, "tieya": 9, "tieza": 3, "alone": 3, "": 5, "a": 2}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = {r.word: r for r in sp.variants(words).collect()}
    assert {rows[w].root for w in ("abc", "abcd", "abcde", "abcdef", "abcdefg", "abcdefgh")} == {"abcdefgh"}
    assert (rows["tieza"].form, rows["tieza"].n_near, rows["tiexa"].form) == ("tiexa", 2, None)
    assert (rows["alone"].root, rows["alone"].n_near, rows["alone"].form_n) == ("alone", 0, None)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert got(sp.variants(sp.vocabulary(docs))) == []
