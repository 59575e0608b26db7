import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    b = bpe.Bpe.load(PATH, PATTERN)
    return b, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=b.ranks, special_tokens={})


CASES = ["", " ", "a", "a" * 5000, "ab" * 3000, " " * 999 + "x", "ÿ" * 777, "é\n\n  x　", "日本語" * 500, "<|endoftext|> it's 123,456!", "\x00\x01", "😀" * 99, "".join(random.Random(1).choice("abcdefgh") for _ in range(20000))]


@pytest.mark.parametrize("text", CASES)
def test_ids_and_round_trip(pair, text):
    b, e = pair
    packed = b.encode(text)
    assert packed == array("I", e.encode_ordinary(text)).tobytes()
    assert b.decode(packed) == text.encode()


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(pair, text):
    b, e = pair
    assert b.encode(text) == array("I", e.encode_ordinary(text)).tobytes()


def test_cache_generations_do_not_change_ids(pair, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    b = bpe.Bpe.load(PATH, PATTERN)
    text = " ".join(f"word{i % 17}" for i in range(200))
    assert b.encode(text) == pair[0].encode(text) and len(b.young) <= 3


def test_columns(spark, pair):
    texts = [None, "", "Hello world", "same", "same", "x" * 30000]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(bpe.round_trip(df, PATH, PATTERN).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(got, texts):
        ids = array("I", pair[1].encode_ordinary(t or ""))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0
    back = df.select("text", bpe.decode_column(bpe.encode_column(df["text"], PATH, PATTERN), PATH, PATTERN).alias("b")).collect()
    assert all(bytes(r["b"]) == (r["text"] or "").encode() for r in back)
