import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import tokenizers

from docsift.llm import packing as pk
from docsift.llm.queries import tokenizer_path

LIBRARY = tokenizers.Tokenizer.from_file(tokenizer_path())
CASES = ["", None, " ", "a \x01 b", "\x01", "x\x01y", "Hello <|endoftext|>x it's\nwe'll", "n" * 9000, "é ́x ﬁ a\x1cb\tq\x85z", "one  two\r\n three"]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a document at a time; the number of bins and their loads."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def loads(steps, capacity):
    bins = defaultdict(list)
    for length, _, n, first, offset, each in steps:
        for i in range(n):
            bins[first + i // each].append((offset + i % each * length, length))
    rooms = []
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        rooms.append(capacity - at)
    return sorted(rooms)


def test_plan_equals_best_fit_decreasing_one_by_one():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 64, 100):
        for _ in range(40):
            top = rng.randint(1, capacity)
            lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 200))]
            steps = pk.plan(Counter(lengths), capacity)
            for length, n in Counter(lengths).items():
                ranks = sorted(r for s in steps if s[0] == length for r in range(s[1], s[1] + s[2]))
                assert ranks == list(range(n))
            assert loads(steps, capacity) == one_by_one(lengths, capacity)


def test_plan_does_not_grow_with_the_input():
    rng = random.Random(2)
    few = Counter(rng.randint(1, 4096) for _ in range(20_000))
    many = {k: n * 100_000 for k, n in few.items()}
    assert len(pk.plan(many)) < 60_000


def test_segment_tree():
    rng, tree, on = random.Random(3), pk.SegmentTree(50), set()
    for _ in range(400):
        at = rng.randint(0, 50)
        on ^= {at}
        tree.set(at, at in on)
        low = rng.randint(0, 50)
        assert tree.least(low) == min((x for x in on if x >= low), default=None)


def test_encoder_agrees_with_the_library(monkeypatch):
    with open(tokenizer_path(), "rb") as f:
        encoder = pk.encoder_of(f.read())
    rng = random.Random(4)
    texts = [x or "" for x in CASES]
    texts += ["".join(rng.choice("theIn's_^`~|0\x1c\x7f\x0b-\r ") for _ in range(rng.randrange(400))) for _ in range(200)]
    assert encoder.plain_ascii
    texts += ["".join(rng.choice("theinrsoaéü'1.! ") for _ in range(rng.randrange(400))) for _ in range(200)]
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1]
    monkeypatch.setattr(type(encoder), "MEMO", 3)
    for text in texts[:20]:
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == ids_of(text)[:-1]


def test_pack(spark, sf):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, "a b", "y"), (3, "a b", "z"), (77, "tok " * 13_000, "w")]
    extra = spark.createDataFrame(rows, "doc_id long, text string, rank string").repartition(3)
    for docs in (extra, spark.read.parquet(f"{sf}/documents.parquet")):
        got = pk.pack(docs, tokenizer_path(), keep_ids=True).collect()
        want = Counter()
        for doc_id, text in docs.select("doc_id", "text").collect():
            ids = ids_of(text)
            for piece, start in enumerate(range(0, len(ids), 4096)):
                part = np.array(ids[start : start + 4096], "<u4").tobytes()
                want[doc_id, piece, start, len(part) // 4, zlib.crc32(part), part] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
        places = defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        for parts in places.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(places) == len(one_by_one([r.length for r in got], 4096))
    assert pk.pack(spark.createDataFrame([], extra.schema), tokenizer_path()).count() == 0
