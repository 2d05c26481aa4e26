import random
import re
from itertools import pairwise

from docsift.operators import parity

KEYED = "key int, text string"


def parts(text):
    w = [x for x in re.split("[^a-z0-9+#]+", text.lower()) if x]
    return {" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def brute(one, two, least=0.6, lines=1, same_key=False):
    out = {}
    for key, text in one:
        for no, line in enumerate((text or "").split("\n")):
            line = " ".join(line.split())
            if len(line) < parity.LEAST:
                continue
            p, best = parts(line), None
            for other, body in two:
                if same_key and other != key:
                    continue
                listed = [(n, x) for n, x in enumerate((body or "").split("\n")) if parts(x)]
                for at in range(len(listed)):
                    for n in range(1, lines + 1):
                        if at + n <= len(listed):
                            q = parts(" ".join(x for _, x in listed[at : at + n]))
                            common = len(p & q)
                            if p and common and common >= least * len(p) - 1e-9:
                                found = (-common, len(q), n, other, listed[at][0])
                                best = found if best is None else min(best, found)
            out[key, no] = (len(p), None, None, None, None, True) if best is None else (len(p), round(-best[0] / len(p), 6), best[3], best[4], best[2], False)
    return out


def got(df):
    return {(r.key, r.block_no): (r.n_shingles, r.ratio, r.other, r.first, r.n_lines, r.missing) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "x"]) for _ in range(n))
    two = [(i, "\n".join(rng.choice(["", line(rng.randrange(1, 12)), line(8)]) for _ in range(rng.randrange(6)))) for i in range(40)] + [(7, None), (8, "\n\n")]
    two += [(50 + i, two[3][1]) for i in range(5)]
    one = [(i, "\n".join([rng.choice(two)[1] or "", line(9), line(3), "- - - - - - - - - - - - -"])) for i in range(15)] + [(30, None), (31, "")]
    return one, two


def test_equals_comparing_all_with_all(spark):
    for seed, least, lines, same_key in ((1, 0.6, 1, False), (2, 0.6, 3, False), (3, 1.0, 2, False), (4, 0.3, 1, True), (5, 0.01, 2, False)):
        one, two = corpus(seed)
        frames = [spark.createDataFrame([(*r, 1, "x") for r in rows], "key int, text string, stretch int, part string").repartition(4) for rows in (one, two)]
        assert got(parity.counterparts(*frames, least=least, lines=lines, same_key=same_key)) == brute(one, two, least, lines, same_key)


LINES = [
    "Kept the tide tables of nine harbours and printed them every week of the year",
    "Trained four crews in reading charts, buoys, lights and the weather at sea",
    "Wrote the rota by which the ferries of three islands meet each other at noon",
    "Bought rope, paint and lamp oil for two winters at a tenth below the old price",
]


def missing(spark, one, two, **more):
    rows = parity.counterparts(spark.createDataFrame([(1, one)], KEYED), spark.createDataFrame([(1, two)], KEYED), same_key=True, **more).collect()
    return [r.block_no for r in sorted(rows, key=lambda r: r.block_no) if r.missing]


def test_order_does_not_matter_and_a_dropped_block_is_named(spark):
    whole = "\n".join(LINES)
    assert missing(spark, whole, "\n".join(reversed(LINES))) == []
    assert missing(spark, whole, "\n".join(LINES[:2] + LINES[3:])) == [2]
    assert missing(spark, whole, None) == [0, 1, 2, 3]


def test_fragments_that_lie_scattered_are_no_counterpart(spark):
    words = LINES[0].split()
    pieces = [" ".join(words[i : i + 5]) for i in range(0, len(words), 4)]
    scattered = "\n".join(x for pair in pairwise([*pieces, ""]) for x in (pair[0], LINES[1], LINES[2]))
    loose = parity.compare_blocks(spark.createDataFrame([(1, LINES[0])], "key long, text string"), spark.createDataFrame([(1, scattered)], "key long, text string")).first()
    assert not loose.missing
    assert missing(spark, LINES[0], scattered) == [0]


def test_wrapped_lines_are_found_in_stretches(spark):
    wrapped = "\n".join(part for x in LINES for part in (x[:40], x[40:]))
    assert missing(spark, "\n".join(LINES), wrapped, lines=3) == []
