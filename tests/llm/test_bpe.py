import hashlib
import random

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import bpe
from docsift.llm.queries import tokenizer_path

MODEL = bpe.model_of(bpe.tokenizer_bytes(tokenizer_path()))
LIBRARY = tokenizers.Tokenizer.from_file(tokenizer_path())

CASES = [
    "", " ", "Hello wörld's  <|endoftext|>abc it's we'll", "x" * 5000, "thethethe" * 900 + "!", "aaa" * 1000,
    "日本語テキスト 123 ４５ ΣΑΣ İstanbul é ́x ﬁ", "a\x1cc\tq <|startoftext|", "a\r\nb\x0bc\x85d", "😀" * 700, "ab1c" * 3000, "\x00 \x01",
]


def ids_of(text):
    return np.frombuffer(MODEL.encode(text), "<u4").tolist()


def agrees(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = ids_of(text)
    assert got == want
    assert "".join(bpe.decode(MODEL, np.array(got))) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases_agree_with_the_library(text):
    agrees(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thein anΣé'\n<|endoftx>rsßK1", max_size=300))
def test_random_texts_agree_with_the_library(text):
    agrees(text)


def test_long_words_agree_with_the_library():
    rng = random.Random(1)
    for letters in ("thein", "abcdefghi", "ab", "éçth"):
        agrees("".join(rng.choice(letters) for _ in range(7000)))


def test_transducer_emits_the_same_ids_for_any_cut():
    rng = random.Random(2)
    word = "".join(rng.choice("theinrso") for _ in range(6000)).encode()
    whole = MODEL.merged([MODEL.inner[b] for b in word[:-1]] + [MODEL.final[word[-1]]])
    feed, out, at, most = bpe.Transducer(MODEL), [], 0, 0
    while at < len(word):
        step = rng.randrange(1, 900)
        out += feed.feed(word[at : at + step])
        most = max(most, len(feed.buffer))
        at += step
    assert out + feed.finish() == whole
    assert most <= MODEL.lookahead + max(MODEL.sizes)


def test_text_stream_holds_back_incomplete_sequences():
    data = "aé日😀z".encode() * 50
    for step in (1, 2, 3, 5, 7):
        stream = bpe.TextStream()
        parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join(parts) + stream.finish() == data.decode()


def test_spelled_decode_gives_the_words_back():
    assert "".join(bpe.decode(MODEL, np.array(ids_of("Grüße an 日本")), spelled=True)) == "grüße an 日本 "


def test_round_trip_query(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Some Text", None), (3, "word " * 30_000, "y"), (3, "Some Text", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, tokenizer_path(), keep=True).collect()
    for row, (doc_id, text, _) in zip(got, rows, strict=True):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        said = LIBRARY.decode(want, skip_special_tokens=False)
        assert (row.doc_id, row.n_tokens, row.ids, row.decoded) == (doc_id, len(want), want, said)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.round_trip(spark.createDataFrame([], docs.schema), tokenizer_path()).count() == 0
